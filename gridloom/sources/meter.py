"""Meter record files: comma-separated lines whose first field names the record type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = 7
STAMP, UNIT, VALUE = 4, 5, 6


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with their file and a row order that grows within each file."""
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.select(
        "line",
        F.input_file_name().alias("file"),
        F.monotonically_increasing_id().alias("row_order"),
    )


def _fields(count: int):
    return F.from_csv("line", ", ".join(f"f{i} string" for i in range(count)), {"mode": "PERMISSIVE"})


def data_records(lines: DataFrame, count: int = FIELDS) -> DataFrame:
    """``D`` records with at least ``count`` fields, parsed once, as a struct column ``r``."""
    data = lines.where(F.col("line").startswith("D,"))
    return data.withColumn("r", _fields(count)).where(F.col(f"r.f{count - 1}").isNotNull())


def parse_readings(lines: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Stamp, unit and MW of every data record; a bad number drops the row.

    ``units`` (column ``unit``) restricts the scan to known units with a semi join.
    """
    rows = (
        data_records(lines)
        .select(
            *[c for c in lines.columns if c != "line"],
            F.col(f"r.f{STAMP}").alias("stamp"),
            F.trim(F.col(f"r.f{UNIT}")).alias("unit"),
            F.col(f"r.f{VALUE}").try_cast("double").alias("mw"),
        )
        .where(F.col("mw").isNotNull())
    )
    return rows if units is None else rows.join(units.select("unit"), "unit", "left_semi")


def distinct_units(readings: DataFrame) -> DataFrame:
    return readings.select("unit").distinct()


def unit_stations(lines: DataFrame, order: str = "row_order") -> DataFrame:
    """Unit to station from data records with more than six fields (fields 4 and 6); the later row wins.

    Field 5 is the date from which the allocation holds.
    """
    rows = data_records(lines, 7).select(
        F.trim(F.col("r.f4")).alias("unit"), F.trim(F.col("r.f6")).alias("station"), order
    )
    return rows.groupBy("unit").agg(F.max_by("station", order).alias("station"))
