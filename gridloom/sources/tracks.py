"""Competition-style wide CSV tracks: one row per zone and hour, weather and power together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.functions import clock, weather

STAMP = "yyyyMMdd H:mm"
# Accumulated source fields and the floor of a rising step.
ACCUMULATED = ("VAR169", "VAR175", "VAR178", "VAR228")
RISING_SHARE = 0.95
STEP_TOLERANCE = -1e-6


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """CSV files under a glob (one per zone for wind), header names as columns."""
    return spark.read.option("header", True).csv(path)


def with_run(frame: DataFrame, stamp: str = "TIMESTAMP") -> DataFrame:
    """Parse the stamp (NULL when bad) and add issue time, valid time and horizon."""
    ts = F.try_to_timestamp(F.trim(F.col(stamp)), F.lit(STAMP))
    issue = clock.run_issue(F.col("valid_time_utc"))
    return (
        frame.withColumn("valid_time_utc", ts)
        .withColumn("issue_time_utc", issue)
        .withColumn("horizon_h", clock.hours_between(F.col("valid_time_utc"), F.col("issue_time_utc")))
    )


def bad_stamps(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("valid_time_utc").isNull())


def rising_shares(frame: DataFrame, columns: list[str], groups: list[str], order: str) -> DataFrame:
    """Per column, the mean over groups of the share of steps that do not fall."""
    w = Window.partitionBy(*groups).orderBy(order)
    steps = frame.select(*groups, *[(F.col(c) - F.lag(c).over(w)).alias(c) for c in columns])
    per_group = steps.groupBy(*groups).agg(
        *[F.avg(F.when(F.col(c).isNotNull(), (F.col(c) >= STEP_TOLERANCE).cast("double"))).alias(c) for c in columns]
    )
    return per_group.agg(*[F.avg(c).alias(c) for c in columns]).unpivot(
        [], columns, "column", "rising_share"
    )


def deaccumulated(column: str, groups: list[str], order: str) -> Column:
    """Increment within a run; the first row keeps its value; never below zero."""
    w = Window.partitionBy(*groups).orderBy(order)
    step = F.coalesce(F.col(column) - F.lag(column).over(w), F.col(column))
    return weather.clip(step, 0.0)


def deaccumulate(frame: DataFrame, columns: list[str], groups: list[str], order: str) -> DataFrame:
    """Difference the columns that really accumulate; leave the others alone.

    The decision is a four-row table folded into the plan as scalar subqueries, so the data is
    neither collected nor scanned per column.
    """
    shares = rising_shares(frame, columns, groups, order)
    out = {}
    for c in columns:
        share = shares.where(F.col("column") == c).select("rising_share").scalar()
        out[c] = F.when(share >= RISING_SHARE, deaccumulated(c, groups, order)).otherwise(F.col(c))
    return frame.withColumns(out)


def solar_weather(raw: DataFrame, prefix: str = "ZONE-SOLAR-") -> DataFrame:
    """Solar track to canonical weather: unit conversions after de-accumulation."""
    u, v = F.col("VAR165").cast("double"), F.col("VAR166").cast("double")
    return raw.select(
        F.concat(F.lit(prefix), F.col("ZONEID").cast("string")).alias("site_id"),
        "issue_time_utc",
        "valid_time_utc",
        "horizon_h",
        weather.joules_to_watts(F.col("VAR169")).alias("ghi_wm2"),
        weather.clip(F.col("VAR164").cast("double"), 0.0, 1.0).alias("cloud_total"),
        weather.kelvin_to_celsius(F.col("VAR167")).alias("temp_2m_c"),
        weather.clip(F.col("VAR157").cast("double"), 0.0, 100.0).alias("rh_pct"),
        weather.pascal_to_hpa(F.col("VAR134")).alias("pressure_hpa"),
        weather.metres_to_mm(F.col("VAR228")).alias("precip_mm"),
        weather.wind_speed(u, v).alias("wind_speed_10m"),
        weather.wind_direction(u, v).alias("wind_dir_10m_deg"),
    )


def wind_weather(raw: DataFrame, prefix: str = "ZONE-WIND-") -> DataFrame:
    """Wind track (union of zone files) to canonical weather."""
    columns = {}
    for level in ("10", "100"):
        u, v = F.col(f"U{level}").cast("double"), F.col(f"V{level}").cast("double")
        columns[f"wind_speed_{level}m"] = weather.wind_speed(u, v)
        columns[f"wind_dir_{level}m_deg"] = weather.wind_direction(u, v)
    return raw.select(
        F.concat(F.lit(prefix), F.col("ZONEID").cast("string")).alias("site_id"),
        "issue_time_utc",
        "valid_time_utc",
        "horizon_h",
        *[c.alias(n) for n, c in columns.items()],
    )


def track_power(raw: DataFrame, column: str, tech: str, prefix: str, capacity: float = 1.0) -> DataFrame:
    """The power half of a track, in units of capacity."""
    mw = F.col(column).cast("double") * capacity
    return raw.select(
        F.concat(F.lit(prefix), F.col("ZONEID").cast("string")).alias("site_id"),
        "valid_time_utc",
        F.lit(tech).alias("tech"),
        mw.alias("power_mw"),
        F.lit(capacity).alias("capacity_mw"),
        mw.isNotNull().alias("is_valid"),
    )
