"""Streaming hourly mean: late and repeated readings, the same result as the batch operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.session import shared_dir

LATENESS = "2 hours"


def hourly_stream(readings: DataFrame, keys: list[str], ts: str, value: str, *, id_column: str, lateness: str = LATENESS) -> DataFrame:
    """Hourly mean per key over a stream; a reading id counts once within the watermark.

    An hour is emitted when the watermark passes its end. State holds open hours and the ids of the
    lateness window only.
    """
    floored = F.when(F.col(value) < 0, 0.0).otherwise(F.col(value))
    return (
        readings.withWatermark(ts, lateness)
        .dropDuplicatesWithinWatermark([id_column])
        .groupBy(*keys, F.window(ts, "1 hour").alias("w"))
        .agg(F.avg(floored).alias("mean_value"))
        .select(*keys, F.col("w.start").alias("valid_time"), "mean_value")
    )


def read_events(spark: SparkSession, folder: str, pattern: str, schema: StructType | None = None) -> DataFrame:
    """Parquet files landing in a folder, as a stream with UTC instants."""
    schema = schema or spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that has landed, then stop."""
    query = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def closed_hours(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Hourly mean per event type for all hours the watermark has closed, read back from the sink."""
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream = hourly_stream(read_events(spark, folder, pattern), ["event_type"], "ts", "value", id_column="event_id")
    run_available(stream, f"{base}/out", f"{base}/state")
    return spark.read.schema("event_type string, valid_time timestamp, mean_value double").parquet(f"{base}/out")
