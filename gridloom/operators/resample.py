"""Hourly resampling, dense calendars, order-aware deduplication and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hourly_mean(
    frame: DataFrame,
    keys: list[str],
    ts: str,
    value: str,
    *,
    out: str = "mean_value",
    floor_zero: bool = True,
    out_time: str = "valid_time",
) -> DataFrame:
    """Sub-hourly readings to an hourly mean per key.

    Meters are floored at zero first; market series are not (negative demand is real). Rows whose
    stamp did not parse are dropped. The aggregate combines map-side, so one hot meter sends at
    most one partial row per hour and task.
    """
    v = F.when(F.col(value) < 0, 0.0).otherwise(F.col(value)) if floor_zero else F.col(value)
    return (
        frame.where(F.col(ts).isNotNull())
        .groupBy(*keys, F.date_trunc("hour", F.col(ts)).alias(out_time))
        .agg(F.avg(v).alias(out))
    )


def dense_hours(
    frame: DataFrame, keys: list[str], ts: str, values: list[str], *, step: str = "1 hour"
) -> DataFrame:
    """Complete each key's calendar between its own first and last stamp; gaps carry NULL.

    After this, a row frame equals a clock frame. Rows with one (keys, ts) are folded into one; ``step`` is
    a fixed length of time. The data is shuffled once, by key, and sorted: every row then emits the empty hours up to
    the next one, so a calendar is written where its rows lie and no task expands or hashes the calendars of all keys.
    """
    series = Window.partitionBy(*keys).orderBy(ts)
    once = frame.repartition(*keys).groupBy(*keys, ts).agg(*[F.max(v).alias(v) for v in values])
    at, first = F.unix_micros(ts), F.unix_micros(F.min(ts).over(series))
    length = F.unix_micros(F.timestamp_micros(F.lit(0)) + F.expr(f"interval {step}"))
    # The calendar starts at the first stamp; other rows may lie between two of its stamps.
    after = F.timestamp_micros(first + F.floor((at - first) / length + 1).cast("long") * length)
    until = F.timestamp_micros(F.unix_micros(F.lead(ts).over(series)) - 1)
    gaps = F.when(F.col("_after") <= F.col("_until"), F.sequence("_after", "_until", F.expr(f"interval {step}")))
    gaps = F.concat(F.array(ts), F.coalesce(gaps, F.array().cast("array<timestamp>")))
    rows = once.withColumns({"_after": after, "_until": until}).select(*keys, *values, F.posexplode(gaps).alias("_n", ts))
    return rows.select(*keys, ts, *[F.when(F.col("_n") == 0, F.col(v)).alias(v) for v in values])


def keep_one(
    frame: DataFrame, keys: list[str], order: list[str], *, keep: str = "first"
) -> DataFrame:
    """One row per key, the first or last by ``order``.

    Written as a struct ``min_by``/``max_by`` so duplicates collapse before the shuffle; a key
    holding most of the rows still reaches the reducer as one row per task.
    """
    rest = [c for c in frame.columns if c not in keys]
    pick = F.min_by if keep == "first" else F.max_by
    row = pick(F.struct(*rest), F.struct(*order)).alias("_row")
    return frame.groupBy(*keys).agg(row).select(*keys, "_row.*").select(*frame.columns)


def fill(column: str, keys: list[str], ts: str) -> Column:
    """Forward then backward fill over an ordered series."""
    w = Window.partitionBy(*keys).orderBy(ts)
    back = F.last(column, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(column, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(back, ahead)


def interpolate(frame: DataFrame, keys: list[str], position: str, value: str) -> DataFrame:
    """Linear interpolation over an integer position; ends hold the nearest known value."""
    w = Window.partitionBy(*keys).orderBy(position)
    before, after = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.col(position))
    marked = frame.select(
        "*",
        F.last(value, ignorenulls=True).over(before).alias("_v0"),
        F.last(known, ignorenulls=True).over(before).alias("_p0"),
        F.first(value, ignorenulls=True).over(after).alias("_v1"),
        F.first(known, ignorenulls=True).over(after).alias("_p1"),
    )
    slope = F.try_divide(F.col("_v1") - F.col("_v0"), F.col("_p1") - F.col("_p0"))
    filled = F.coalesce(
        F.col(value),
        F.col("_v0") + slope * (F.col(position) - F.col("_p0")),
        F.col("_v0"),
        F.col("_v1"),
    )
    return marked.withColumn(value, filled).drop("_v0", "_p0", "_v1", "_p1")


def circular_mean_window(
    frame: DataFrame, keys: list[str], position: str, value: str, period: int, half_width: int
) -> DataFrame:
    """Centred rolling mean on a ring of ``period`` positions, missing values skipped.

    Only the rows within ``half_width`` of either seam are repeated on the far side, so the copy
    is a few rows per key rather than three rounds of the year.
    """
    turn = (
        F.when(F.col(position) < half_width + 1, F.array(F.lit(0), F.lit(1)))
        .when(F.col(position) >= period - half_width - 1, F.array(F.lit(0), F.lit(-1)))
        .otherwise(F.array(F.lit(0)))
    )
    tiled = frame.withColumn("_turn", F.explode(turn)).withColumn(
        "_at", F.col(position) + F.col("_turn") * period
    )
    w = Window.partitionBy(*keys).orderBy("_at").rangeBetween(-half_width, half_width)
    return (
        tiled.withColumn(value, F.avg(value).over(w)).where(F.col("_turn") == 0).drop("_turn", "_at")
    )
