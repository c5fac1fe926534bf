"""Joins whose keys need care: issue times, fallbacks, cells, block offsets, parameter grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import clock
from gridloom.operators.resample import fill, keep_one


def value_at_issue(frame: DataFrame, measured: DataFrame, columns: dict[str, str], order: list[str]) -> DataFrame:
    """Measured values at each row's issue time: an exact shifted equi join, missing reads as zero.

    ``columns`` maps measured column to new column. Repeated measured hours resolve to the first by
    ``order``, so the join never multiplies rows.
    """
    once = keep_one(measured, ["site_id", "valid_time"], order).select(
        "site_id", F.col("valid_time").alias("_at"), *[F.col(c).alias(n) for c, n in columns.items()]
    )
    at = F.col("valid_time") - F.make_dt_interval(hours=F.col("horizon_h").cast("int"))
    joined = frame.withColumn("_at", at).join(once, ["site_id", "_at"], "left").drop("_at")
    return joined.withColumns({n: F.coalesce(n, F.lit(0.0)) for n in columns.values()})


def with_fallback(frame: DataFrame, lookup: DataFrame, keys: list[str], site_mean: DataFrame) -> DataFrame:
    """Climatology value, else the site mean, else zero: column ``climatology_mw``."""
    joined = frame.join(lookup.withColumnRenamed("mean_mw", "_a"), keys, "left").join(
        site_mean.withColumnRenamed("mean_mw", "_b"), "site_id", "left"
    )
    return joined.withColumn("climatology_mw", F.coalesce("_a", "_b", F.lit(0.0))).drop("_a", "_b")


def gather_variables(parts: dict[str, DataFrame], keys: list[str], value: str = "value") -> DataFrame:
    """Full outer merge of per-variable tables as one union and one aggregation.

    A chain of outer joins would shuffle every table once per step.
    """
    long = None
    for name, part in parts.items():
        tagged = part.select(*keys, F.lit(name).alias("_var"), F.col(value).alias("_x"))
        long = tagged if long is None else long.unionByName(tagged)
    return long.groupBy(*keys).agg(*[F.max(F.when(F.col("_var") == n, F.col("_x"))).alias(n) for n in parts])


def cell_keys(latitude: Column, longitude: Column, resolution: float) -> dict[str, Column]:
    return {
        "lat_cell": F.bround(latitude / resolution).cast("long"),
        "lon_cell": F.bround(longitude / resolution).cast("long"),
    }


def distinct_cells(sites: DataFrame, resolution: float) -> DataFrame:
    """One representative site per cell (the smallest id) and the number sharing it."""
    keyed = sites.withColumns(cell_keys(F.col("latitude"), F.col("longitude"), resolution))
    return keyed.groupBy("lat_cell", "lon_cell").agg(F.min("site_id").alias("owner"), F.count("*").alias("sharing"))


def fan_out_cells(cell_weather: DataFrame, sites: DataFrame, resolution: float) -> DataFrame:
    """Weather of one cell to every site in it."""
    keyed = sites.withColumns(cell_keys(F.col("latitude"), F.col("longitude"), resolution)).select("site_id", "lat_cell", "lon_cell")
    return cell_weather.join(keyed, ["lat_cell", "lon_cell"])


def complete_hours(rows: DataFrame, group: list[str], needed: Column) -> DataFrame:
    """Hours at which every member of a group has a complete row."""
    members = rows.select(*group, "site_id").distinct().groupBy(*group).agg(F.count("*").alias("_members"))
    whole = (
        rows.where(needed).select(*group, "site_id", "valid_time").distinct()
        .groupBy(*group, "valid_time").agg(F.count("*").alias("_n"))
    )
    return whole.join(members, group).where(F.col("_n") == F.col("_members")).select(*group, "valid_time")


def common_hours(rows: DataFrame, demand: DataFrame) -> DataFrame:
    """Hours complete for all technologies of a region and present in its demand."""
    per_tech = complete_hours(rows, ["region", "tech"], F.col("actual_mw").isNotNull() & F.col("p50_mw").isNotNull())
    techs = rows.select("region", "tech").distinct().groupBy("region").agg(F.count("*").alias("_t"))
    both = per_tech.groupBy("region", "valid_time").agg(F.count("*").alias("_n")).join(techs, "region")
    return (
        both.where(F.col("_n") == F.col("_t")).select("region", "valid_time")
        .intersect(demand.where(F.col("demand_mw").isNotNull()).select("region", "valid_time"))
    )


def align_price(hours: DataFrame, price: DataFrame, column: str = "rrp_aud_mwh") -> DataFrame:
    """Price on a dense window, gaps filled forward then backward."""
    joined = hours.join(price.select("region", "valid_time", column), ["region", "valid_time"], "left")
    return joined.withColumn(column, fill(column, ["region"], "valid_time"))


def forecast_vs_outcome(points: DataFrame, outcomes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Forecast hours with the summed outcome of a region's sites, apart for each of ``keys`` (leads)."""
    actual = outcomes.groupBy("region", "valid_time", *(keys or [])).agg(F.sum("actual_mw").alias("actual_mw"), F.count("*").alias("sites"))
    return points.join(actual, ["region", "valid_time"])


def small_map(table: DataFrame, key: Column, value: Column) -> Column:
    """A table of a few dozen rows (regions, technologies, lead buckets) as one map literal.

    It enters the plan as a scalar subquery, so the large side is neither shuffled on a key with a
    handful of values nor joined at all. Not for tables keyed by site. Repeated keys keep their
    largest value.
    """
    once = table.groupBy(key.alias("k")).agg(F.max(value).alias("v"))
    return once.agg(F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()


def widening_lookup(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Per-row widening by lead bucket (and region or technology), falling back to ``all``, then 0.

    ``table`` is ``(keys, lead_bucket, widening)``: at most four rows per region.
    """
    def name(bucket: Column) -> Column:
        return F.concat_ws("|", *keys, bucket)

    cells = small_map(table, name(F.col("lead_bucket")), F.col("widening"))
    bucket = clock.lead_bucket(F.col("horizon_h"))
    value = F.coalesce(F.try_element_at(cells, name(bucket)), F.try_element_at(cells, name(F.lit("all"))), F.lit(0.0))
    return rows.withColumn("widening", value)


def with_grid(frame: DataFrame, grid: dict[str, list[float]]) -> DataFrame:
    """Every row once per parameter combination, as inline arrays: no join, no shuffle."""
    out = frame
    for name, values in grid.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def region_overview(sites: DataFrame, accuracy: DataFrame, hours: DataFrame) -> DataFrame:
    """Regions with capacity, accuracy where known, and whether a balance is available."""
    capacity = sites.groupBy(F.col("market_region").alias("region")).agg(
        F.sum("capacity_mw").alias("capacity_mw"), F.count("*").alias("sites")
    )
    have = hours.groupBy("region").agg(F.count("*").alias("hours"))
    return capacity.join(accuracy, "region", "left").join(have, "region", "left").withColumn(
        "available", F.coalesce(F.col("hours") > 0, F.lit(False))
    )


def overlap_days(left: DataFrame, right: DataFrame) -> DataFrame:
    """Whole days of overlap per region between two hourly tables."""
    a = left.groupBy("region").agg(F.min("valid_time").alias("a0"), F.max("valid_time").alias("a1"))
    b = right.groupBy("region").agg(F.min("valid_time").alias("b0"), F.max("valid_time").alias("b1"))
    shared = F.unix_seconds(F.least("a1", "b1")) - F.unix_seconds(F.greatest("a0", "b0"))
    return a.join(b, "region").select("region", F.greatest(F.floor(shared / 86400), F.lit(0)).alias("days"))


def envelope_lookup(rows: DataFrame, envelope: DataFrame) -> DataFrame:
    """Empirical clear-sky power by (site, 5-day bin, hour); an unseen cell reads as zero."""
    keyed = rows.withColumns({"doy_bin": clock.day_bin(F.col("valid_time"), 5), "hour": F.hour("valid_time")})
    joined = keyed.join(envelope.select("site_id", "doy_bin", "hour", "envelope_mw"), ["site_id", "doy_bin", "hour"], "left")
    return joined.withColumn("clearsky_mw", F.coalesce("envelope_mw", F.lit(0.0))).drop("envelope_mw")


def resolve_requests(requests: DataFrame, sites: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests resolved against the site table, and those that cannot be.

    A named site takes the request's values where given; a request without a name must carry all of
    latitude, longitude, technology and capacity. Returns ``(resolved, rejected)``.
    """
    fields = ["tech", "capacity_mw", "latitude", "longitude"]
    known = sites.select(F.col("site_id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields])
    joined = requests.join(known, F.col("site_id") == F.col("_id"), "left")
    merged = joined.withColumns({c: F.coalesce(c, f"_{c}") for c in fields})
    ad_hoc = F.col("site_id").isNull()
    complete = F.lit(True)
    for c in fields:
        complete = complete & F.col(c).isNotNull()
    good = (F.col("_id").isNotNull() | ad_hoc) & complete
    reason = F.when(ad_hoc, "incomplete coordinates").otherwise("unknown site")
    columns = [c for c in requests.columns if c not in fields]
    resolved = merged.where(good).select(*columns, *fields, ad_hoc.alias("ad_hoc"))
    rejected = merged.where(~good).select(*columns, reason.alias("reason"))
    return resolved, rejected


def most_common_lead(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keep only rows at the lead with the most rows per key (the shortest among equals)."""
    counts = frame.groupBy(*keys, "horizon_h").agg(F.count("*").alias("_n"))
    best = counts.groupBy(*keys).agg(F.max_by("horizon_h", F.struct("_n", -F.col("horizon_h"))).alias("horizon_h"))
    return frame.join(best, [*keys, "horizon_h"], "left_semi")


def ordered_head(frame: DataFrame, order: list[str], n: int) -> DataFrame:
    return frame.orderBy(*order).limit(n)


def rank_within(frame: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
