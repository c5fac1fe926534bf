"""Nested JSON payloads, metadata documents and flat exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nest(frame: DataFrame, keys: list[str], order: str, fields: list[str], out: str = "points") -> DataFrame:
    """One row per key with an ordered array of structs.

    For payload-sized groups only: a window of hours or a 12 x 24 grid per region.
    """
    item = F.struct(order, *[f for f in fields if f != order])
    return frame.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias(out))


def write_json(frame: DataFrame, path: str, by: str = "region") -> None:
    frame.write.mode("overwrite").partitionBy(by).json(path)


def write_flat(frame: DataFrame, path: str, fmt: str = "csv") -> None:
    writer = frame.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown export format {fmt}")


def trained_sites(documents: DataFrame, column: str = "document") -> DataFrame:
    """Distinct site ids over metadata documents ``{"trained_sites": [...]}``."""
    parsed = F.from_json(column, "trained_sites array<string>")
    return documents.select(F.explode(parsed["trained_sites"]).alias("site_id")).distinct()


def region_accuracy(documents: DataFrame, column: str = "document") -> DataFrame:
    """Per-region accuracy entries ``{"regions": {"R1": {"nmae": x, "coverage": y}}}``."""
    entry = "struct<nmae:double, coverage:double>"
    parsed = F.from_json(column, f"regions map<string, {entry}>")
    rows = documents.select(F.explode(parsed["regions"]).alias("region", "m"))
    return rows.select("region", F.col("m.nmae").alias("nmae"), F.col("m.coverage").alias("coverage"))


def calibration_maps(documents: DataFrame, column: str = "document") -> DataFrame:
    """Calibration documents ``{region: {event: {"x": [...], "y": [...], "n": k}}}`` as rows."""
    leaf = "struct<x:array<double>, y:array<double>, n:int>"
    parsed = F.from_json(column, f"map<string, map<string, {leaf}>>")
    regions = documents.select(F.explode(parsed).alias("region", "events"))
    return regions.select("region", F.explode("events").alias("event", "m")).select(
        "region", "event", F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.n").alias("n")
    )


def save_calibration(maps: DataFrame, path: str) -> None:
    """Write one document per region; the inverse of ``calibration_maps`` over the folder."""
    leaf = F.struct("x", "y", "n")
    events = F.map_from_entries(F.collect_list(F.struct("event", leaf)))
    documents = maps.groupBy("region").agg(events.alias("events"))
    documents.select(F.to_json(F.map_from_arrays(F.array("region"), F.array("events")))).write.mode(
        "overwrite"
    ).text(path)


def parallel_points(payloads: DataFrame, keys: list[str], arrays: list[str], horizon: int) -> DataFrame:
    """Parallel arrays to point rows, horizon = position + 1, trimmed to ``horizon``."""
    zipped = F.arrays_zip(*[F.slice(a, 1, horizon).alias(a) for a in arrays])
    return payloads.select(*keys, F.posexplode(zipped).alias("pos", "p")).select(
        *keys, (F.col("pos") + 1).alias("horizon_h"), *[F.col(f"p.{a}").alias(a) for a in arrays]
    )
