"""Splits, folds and seeded orders that any engine can repeat.

Random picks are orders of ``md5(id || seed)``: the same on every run, partitioning and engine.
Time cutoffs are scalar subqueries in the plan; no value travels through the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shares of the splits.
TEST_SITES = 0.20
CALIB_SITES = 0.10
VAL_TIME = 0.125
DEMAND_TEST, DEMAND_CALIB, DEMAND_VAL = 0.20, 0.10, 0.10


def seeded(column: Column, seed: int) -> Column:
    return F.md5(F.concat(column.cast("string"), F.lit(f"#{seed}")))


def distributed_rank(frame: DataFrame, order: Column, *, prefix: int = 2, out: str = "rank") -> DataFrame:
    """Global 1-based rank by a unique text key without one global sort task.

    Rows are ranked inside their key prefix; the counts of the prefixes (256 for a two-digit hash)
    are summed in a table of that size and added as offsets.
    """
    keyed = frame.withColumn("_o", order).withColumn("_p", F.substring("_o", 1, prefix))
    offsets = keyed.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_o"))
    return keyed.withColumn(out, inside).join(offsets, "_p").withColumn(out, F.col(out) + F.col("_off")).drop("_o", "_p", "_off")


def _whole(n: Column, share: float) -> Column:
    return F.greatest(F.lit(1), F.bround(n * share))


def site_groups(frame: DataFrame, seed: int = 42) -> DataFrame:
    """Sites as ``test`` (20 %), ``calib`` (10 %) or ``fit``, by seeded order."""
    sites = frame.select("site_id").distinct()
    ranked = distributed_rank(sites, seeded(F.col("site_id"), seed))
    n = sites.agg(F.count("*")).scalar()
    held = _whole(n, TEST_SITES)
    group = (
        F.when(F.col("rank") <= held, "test").when(F.col("rank") <= held + _whole(n, CALIB_SITES), "calib").otherwise("fit")
    )
    return ranked.select("site_id", group.alias("site_group"))


def _micros(ts: str = "valid_time") -> Column:
    return F.unix_micros(F.col(ts))


def _cutoff(frame: DataFrame, share: float) -> Column:
    """First stamp plus a share of the span, in microseconds, as a scalar subquery."""
    lo, hi = F.min(_micros()), F.max(_micros())
    return frame.agg(lo + (hi - lo) * share).scalar()


def make_split(frame: DataFrame, seed: int = 42, groups: DataFrame | None = None) -> DataFrame:
    """Site-disjoint four-way split: column ``split`` in train, val, calib, test. ``groups`` are the frame's ``site_groups`` where they are known."""
    grouped = frame.join(site_groups(frame, seed) if groups is None else groups, "site_id")
    cutoff = _cutoff(grouped.where("site_group = 'fit'"), 1.0 - VAL_TIME)
    label = F.when(F.col("site_group") != "fit", F.col("site_group")).when(_micros() > cutoff, "val").otherwise("train")
    return grouped.withColumn("split", label).drop("site_group")


def holdout_split(frame: DataFrame, fraction: float) -> DataFrame:
    """Final contiguous time holdout, cut between hours: column ``is_holdout``."""
    return frame.withColumn("is_holdout", _micros() > _cutoff(frame, 1.0 - fraction))


def forward_folds(frame: DataFrame, n_folds: int) -> DataFrame:
    """Expanding-window folds: each row once per fold it serves, with ``fold`` and ``role``.

    Fold i trains on all time up to edge i and validates on the next block.
    """
    lo = frame.agg(F.min(_micros())).scalar()
    hi = frame.agg(F.max(_micros())).scalar()
    staged = frame.withColumn("_part", F.when(hi > lo, (_micros() - lo) * (n_folds + 1.0) / (hi - lo)).otherwise(0.0))
    # Edge i lies at i parts; a stamp exactly on an edge still belongs to the earlier side.
    block = F.greatest(F.ceil(F.col("_part") - 1e-9), F.lit(1)).cast("int")
    folds = F.sequence(F.lit(1), F.lit(n_folds))
    roles = F.filter(
        F.transform(folds, lambda i: F.struct(i.alias("fold"), F.when(F.col("_block") <= i, "train").when(F.col("_block") == i + 1, "valid").alias("role"))),
        lambda r: r["role"].isNotNull(),
    )
    return staged.withColumn("_block", block).withColumn("_r", F.explode(roles)).select(*frame.columns, "_r.fold", "_r.role")


def time_blocks(frame: DataFrame) -> DataFrame:
    """Four contiguous blocks of time: 60 % train, 10 % val, 10 % calib, 20 % test."""
    hi, lo = F.max(_micros()), F.min(_micros())
    span = hi - lo
    test = frame.agg(hi - span * DEMAND_TEST).scalar()
    calib = frame.agg(hi - span * DEMAND_TEST - span * DEMAND_CALIB).scalar()
    val = frame.agg(hi - span * DEMAND_TEST - span * DEMAND_CALIB - span * DEMAND_VAL).scalar()
    t = _micros()
    label = F.when(t < val, "train").when(t < calib, "val").when(t < test, "calib").otherwise("test")
    return frame.withColumn("split", label)


def site_folds(sites: DataFrame, k: int) -> DataFrame:
    """Sites dealt round-robin over ``k`` folds in id order; fewer sites than folds get one each."""
    unique = sites.select("site_id").distinct()
    # What the least and the greatest id begin with, all do; ranks are split by the three characters after it.
    ends = unique.agg(F.coalesce(F.min("site_id"), F.lit("")), F.coalesce(F.max("site_id"), F.lit(""))).first()
    ranked = distributed_rank(unique, F.col("site_id"), prefix=len(os.path.commonprefix(list(ends))) + 3)
    return ranked.select("site_id", F.pmod(F.col("rank") - 1, F.lit(k)).cast("int").alias("fold"))


def share_summary(frame: DataFrame, key: str) -> DataFrame:
    """Rows and percent per value; the total is a window over the few counts."""
    counts = frame.groupBy(key).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def seeded_windows(starts: DataFrame, keys: list[str], n: int, seed: int, ts: str = "valid_time") -> DataFrame:
    """Up to ``n`` window starts per key in seeded order, with their ``pick`` number from 0."""
    h = seeded(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), seed)
    w = Window.partitionBy(*keys).orderBy(h)
    return starts.withColumn("pick", F.row_number().over(w) - 1).where(F.col("pick") < n)


def scenario_picks(starts: DataFrame, keys: list[str], n_scenarios: int, seed: int, ts: str = "block_start") -> DataFrame:
    """A block start for each scenario: without repeats while blocks last, then cycling.

    ``(keys, scenario, block_start)``; at most ``n_scenarios`` rows per key.
    """
    h = seeded(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), seed)
    w = Window.partitionBy(*keys)
    ranked = starts.select(
        *keys, ts, (F.row_number().over(w.orderBy(h)) - 1).alias("_r"), F.count("*").over(w).alias("_n")
    ).where(F.col("_r") < n_scenarios)
    # Block r serves scenarios r, r + n, r + 2n, ...
    repeats = F.sequence(F.col("_r").cast("int"), F.lit(n_scenarios - 1), F.col("_n").cast("int"))
    return ranked.select(*keys, F.explode(repeats).alias("scenario"), F.col(ts).alias("block_start"))
