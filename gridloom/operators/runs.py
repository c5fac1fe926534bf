"""Gaps and islands: runs of a state, contiguous blocks, template windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mark_runs(frame: DataFrame, keys: list[str], ts: str, state: Column, *, step_seconds: int | None = None) -> DataFrame:
    """Number the runs of equal ``state`` per key: columns ``_state`` and ``_run``.

    Consecutive means the next row; with ``step_seconds`` a hole in the clock also ends a run.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    stated = frame.withColumn("_state", state)
    previous = F.lag("_state").over(w)
    starts = previous.isNull() | ~previous.eqNullSafe(F.col("_state"))
    if step_seconds is not None:
        gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(ts).over(w).cast("timestamp"))
        starts = starts | F.coalesce(gap != step_seconds, F.lit(False))
    flagged = stated.withColumn("_new", starts.cast("int"))
    return flagged.withColumn("_run", F.sum("_new").over(w)).drop("_new")


def state_runs(frame: DataFrame, keys: list[str], ts: str, state: Column, measures: list[Column], **kw) -> DataFrame:
    """One row per run: keys, state, first and last stamp, row count, measures."""
    marked = mark_runs(frame, keys, ts, state, **kw)
    return (
        marked.groupBy(*keys, "_run", F.col("_state").alias("state"))
        .agg(F.min(ts).alias("starts"), F.max(ts).alias("ends"), F.count("*").alias("length"), *measures)
        .drop("_run")
    )


def runs_where(
    frame: DataFrame, keys: list[str], ts: str, flag: Column, measures: list[Column], *, min_length: int = 1, **kw
) -> DataFrame:
    """Runs in which ``flag`` holds, at least ``min_length`` rows long."""
    found = state_runs(frame, keys, ts, F.coalesce(flag, F.lit(False)), measures, **kw)
    return found.where(F.col("state") & (F.col("length") >= min_length)).drop("state")


def event_runs(points: DataFrame, kind: str, *, threshold: float = 0.5, min_hours: int = 2) -> DataFrame:
    """Hours in a row whose probability is at or over the threshold: span, peak, energy.

    A run ends at the end of its window (``window_start``, where points have one) and at a hole in the
    clock. Values stay unrounded; rounding belongs to the export.
    """
    p = F.col(f"p_{kind}")
    keys = [c for c in ("region", "window_start") if c in points.columns]
    found = runs_where(
        points, keys, "valid_time", p >= threshold,
        [F.max(p).alias("peak_probability"), F.sum(f"expected_{kind}_mw").alias("energy_mwh")],
        min_length=min_hours, step_seconds=3600,
    )
    return found.select(
        *keys, F.lit(kind).alias("kind"), F.col("starts").alias("from_utc"), F.col("ends").alias("to_utc"),
        F.col("length").alias("hours"), "peak_probability", "energy_mwh",
    )


def longest_runs(runs: DataFrame, keys: list[str], *, n: int = 1) -> DataFrame:
    """The ``n`` longest runs per key, earliest first among equals. Runs are few per key."""
    w = Window.partitionBy(*keys).orderBy(F.col("length").desc(), F.col("starts"))
    return runs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def window_starts(times: DataFrame, keys: list[str], hours: int, ts: str = "valid_time") -> DataFrame:
    """Every stamp from which the next ``hours`` stamps are consecutive on the clock.

    ``times`` is unique per (keys, ts). The n-th row ahead must lie exactly n hours ahead.
    """
    w = Window.partitionBy(*keys).orderBy(ts)
    ahead = F.lead(ts, hours - 1).over(w)
    exact = F.unix_seconds(ahead) - F.unix_seconds(F.col(ts)) == (hours - 1) * 3600
    return times.withColumn("_ok", exact).where("_ok").drop("_ok")


def template_starts(
    store: DataFrame, hours: int, *, start_hour: int | Column | None = None, min_coverage: float = 0.8,
    group: str = "region",
) -> DataFrame:
    """Block starts usable as templates: consecutive hours, and enough sites complete over the block.

    ``store`` is long: ``group, valid_time, site_id, residual``. Completeness is a per-site trailing
    count, so only counts, never blocks, are shuffled.
    """
    known = store.where(F.col("residual").isNotNull())
    stamps = store.groupBy(group, "valid_time").agg(F.count("*").alias("_n"))
    starts = window_starts(stamps.select(group, "valid_time"), [group], hours)
    if start_hour is not None:
        starts = starts.where(F.hour("valid_time") == start_hour)
    # A site completes a block when its own next `hours` stamps are consecutive too.
    complete = (
        window_starts(known.select(group, "site_id", "valid_time"), [group, "site_id"], hours)
        .groupBy(group, "valid_time").agg(F.count("*").alias("complete"))
    )
    sites = store.select(group, "site_id").distinct().groupBy(group).agg(F.count("*").alias("sites"))
    return (
        starts.join(complete, [group, "valid_time"])
        .join(sites, group)
        .where(F.col("complete") >= F.col("sites") * min_coverage)
        .select(group, F.col("valid_time").alias("block_start"), "complete", "sites")
    )


def quietest_window(points: DataFrame, keys: list[str], ts: str, value: str, hours: int = 4) -> DataFrame:
    """The window of ``hours`` rows with the least total; the earliest wins a tie."""
    w = Window.partitionBy(*keys).orderBy(ts).rowsBetween(0, hours - 1)
    summed = points.select(
        *keys, ts, F.sum(value).over(w).alias("total"), F.max(ts).over(w).alias("ends"), F.count("*").over(w).alias("_n")
    ).where(F.col("_n") == hours)
    # Totals are compared at micro-unit precision so float noise cannot break a tie.
    best = F.min_by(F.struct(ts, "ends", "total"), F.struct(F.round("total", 6), ts)).alias("b")
    return summed.groupBy(*keys).agg(best).select(
        *keys, F.col(f"b.{ts}").alias("starts"), F.col("b.ends").alias("ends"), F.col("b.total").alias("total")
    )


def operating_signals(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per forecast: hours near rated output, steepest ramp and when, ceiling hours, widest band."""
    w = Window.partitionBy(*keys).orderBy("valid_time")
    p50, cap = F.col("p50_mw"), F.greatest(F.col("capacity_mw"), F.lit(1.0))
    marked = points.withColumns(
        {"_ramp": F.abs(p50 - F.lag(p50).over(w)), "_width": F.col("p90_mw") - F.col("p10_mw")}
    )
    clear = F.col("clearsky_mw")
    # Equal ramps and widths resolve to the earliest hour.
    first = -F.unix_seconds("valid_time")
    return marked.groupBy(*keys).agg(
        F.count("*").alias("hours"),
        F.count_if(p50 >= cap * 0.9).alias("near_rated"),
        F.max("_ramp").alias("max_ramp"),
        F.max_by("valid_time", F.struct(F.round("_ramp", 6), first)).alias("ramp_at"),
        F.count_if((clear > 0) & (p50 >= F.least(clear, cap) * 0.98)).alias("at_ceiling"),
        F.max("_width").alias("widest_band"),
        F.max_by("valid_time", F.struct(F.round("_width", 6), first)).alias("widest_at"),
    )
