"""Canonical tables: readers with pushdown, sinks, the site dimension and its upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.resample import keep_one
from gridloom.session import materialise

DEFAULT_TILT_CAP = 40.0
DEFAULT_HUB_M = 100.0
DEFAULT_ROTOR_M = 90.0


def read_canonical(spark: SparkSession, path: str, *, tech: str | None = None, site_id: str | None = None) -> DataFrame:
    """A canonical Parquet table; both filters reach the scan."""
    frame = spark.read.parquet(path)
    if tech is not None:
        frame = frame.where(F.col("tech") == tech)
    if site_id is not None:
        frame = frame.where(F.col("site_id") == site_id)
    return frame


def write_canonical(frame: DataFrame, path: str, *, by: tuple[str, ...] = ("tech",), ts: str = "valid_time") -> None:
    """Write partitioned by ``by`` and month, so readers prune both.

    Rows are range-partitioned by month, site and time first: files cover narrow key ranges, a
    month or site holding most rows is still split over many tasks, and no task opens one file
    per partition.
    """
    order = [*by, "month", "site_id", ts]
    monthly = frame.withColumn("month", F.date_format(ts, "yyyy-MM"))
    (
        monthly.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.mode("overwrite")
        .partitionBy(*by, "month")
        .parquet(path)
    )


def load_months(frame: DataFrame, path: str, *, by: tuple[str, ...] = ("tech",), key: tuple[str, ...] = ("site_id", "valid_time"), ts: str = "valid_time") -> None:
    """Load rows into a canonical table: months that ``frame`` has rows of are merged with what is there, others stay.

    A row replaces the stored one with its key, so loading a month twice changes nothing. Only the partitions of
    (``by``, month) that the rows fall in are read and written again. Of rows of ``frame`` with one key the least, by
    its other columns, counts.
    """
    spark = frame.sparkSession
    parts, keys = [*by, "month"], [*by, "month", *key]
    monthly = frame.withColumn("month", F.date_format(ts, "yyyy-MM"))
    fresh = keep_one(monthly, keys, [c for c in monthly.columns if c not in keys])
    if _exists(spark, path):
        fresh = materialise(fresh)
        stored = spark.read.option("basePath", path).schema(fresh.schema).parquet(path)
        touched = F.lit(False)
        for r in fresh.select(*parts).distinct().collect():  # a few partitions, which prune the scan
            here = F.lit(True)
            for c in parts:
                here = here & F.col(c).eqNullSafe(r[c])
            touched = touched | here
        old = stored.where(touched)
        # Written aside first: the files that are read are the ones to be replaced.
        fresh = materialise(old.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh))
    order = [*parts, *key]
    rows = fresh.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def preferred_corpora(halves: DataFrame, preference: list[str]) -> DataFrame:
    """Corpora whose weather and power halves both exist, most preferred first.

    ``halves`` has ``corpus, half``; the catalogue is a few rows.
    """
    rank = F.array_position(F.array(*[F.lit(c) for c in preference]), F.col("corpus"))
    return (
        halves.groupBy("corpus")
        .agg(F.collect_set("half").alias("halves"))
        .where(F.array_contains("halves", "weather") & F.array_contains("halves", "power"))
        .select("corpus", rank.alias("preference"))
        .where(F.col("preference") > 0)
    )


def table_halves(spark: SparkSession, corpora: list[str]) -> DataFrame:
    """Catalogue lookup of the ``<corpus>_weather`` and ``<corpus>_power`` tables."""
    found = [
        (c, half)
        for c in corpora
        for half in ("weather", "power")
        if spark.catalog.tableExists(f"{c}_{half}")
    ]
    return spark.createDataFrame(found, "corpus string, half string")


def with_site_defaults(sites: DataFrame) -> DataFrame:
    """Fill geometry by technology; a stated zero is a value and stays."""
    solar, wind = F.col("tech") == "solar", F.col("tech") == "wind"
    lat = F.col("latitude")
    return sites.withColumns(
        {
            "tilt_deg": F.coalesce("tilt_deg", F.when(solar, F.least(F.abs(lat), F.lit(DEFAULT_TILT_CAP)))),
            "azimuth_deg": F.coalesce("azimuth_deg", F.when(solar, F.when(lat >= 0, 180.0).otherwise(0.0))),
            "hub_height_m": F.coalesce("hub_height_m", F.when(wind, DEFAULT_HUB_M)),
            "rotor_diameter_m": F.coalesce("rotor_diameter_m", F.when(wind, DEFAULT_ROTOR_M)),
        }
    )


def duplicate_ids(sites: DataFrame, key: str = "site_id") -> DataFrame:
    return sites.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def load_sites(sites: DataFrame) -> DataFrame:
    """The site dimension with defaults; raises when an id repeats."""
    twice = duplicate_ids(sites).take(1)
    if twice:
        raise ValueError(f"duplicate site_id {twice[0]['site_id']}")
    return with_site_defaults(sites)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New non-null fields override, old fields survive, unknown ids are added."""
    rest = [c for c in old.columns if c != key]
    joined = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full")

    def merged(c: str) -> Column:
        fresh = [F.col(f"n.{c}")] if c in new.columns else []
        return F.coalesce(*fresh, F.col(f"o.{c}")).alias(c)

    return joined.select(merged(key), *[merged(c) for c in rest])


def by_tech(sites: DataFrame, tech: str) -> DataFrame:
    return sites.where(F.col("tech") == tech)


def by_region(sites: DataFrame, region: str, tech: str | None = None) -> DataFrame:
    """Sites of a region, matched without case or outer blanks."""
    hits = sites.where(F.upper(F.trim("market_region")) == region.strip().upper())
    return hits if tech is None else by_tech(hits, tech)


def month_range(spans: DataFrame, start: str, end: str) -> DataFrame:
    """First days of the months a span covers, ending at its last complete month."""
    last = F.add_months(F.trunc(F.date_add(F.to_date(end), 1), "month"), -1)
    first = F.trunc(F.to_date(start), "month")
    return spans.where(first <= last).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month")
    )


def write_ensemble(ensemble: DataFrame, path: str) -> None:
    """Persist scenarios long, partitioned by region; reload prunes on ``scenario``."""
    (
        ensemble.repartitionByRange("region", "scenario", "valid_time")
        .write.mode("overwrite")
        .partitionBy("region")
        .parquet(path)
    )


def first_scenarios(ensemble: DataFrame, n: int) -> DataFrame:
    return ensemble.where(F.col("scenario") < n)
