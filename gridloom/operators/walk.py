"""Saturating running sums (a store that fills and empties) without one long sequential fold.

One step moves the level by ``delta`` and clamps it to [0, capacity]. Clamped shifts compose: a
whole block of steps acts on the starting level as ``min(max(x + a, lo), hi)``. So each block is
folded on its own, the few block effects are chained, and each block is replayed from its known
start. Blocks are calendar months or shorter, which bounds every array, and all blocks of all
series and sizes run in parallel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clamp(x: Column, capacity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(capacity, x))


def saturating_totals(
    steps: DataFrame, keys: list[str], block: str, order: str, delta: str, sizes: DataFrame, *, start: float = 0.0
) -> DataFrame:
    """Total rise and fall of the level per (keys, capacity), starting from ``start``.

    ``sizes`` has the keys and ``capacity``; a handful of sizes per key.
    """
    caps = sizes.groupBy(*keys).agg(F.sort_array(F.collect_set(F.col("capacity").cast("double"))).alias("_caps"))
    blocks = (
        steps.groupBy(*keys, block)
        .agg(F.array_sort(F.collect_list(F.struct(order, delta))).alias("_s"))
        .select(*keys, block, F.col(f"_s.{delta}").alias("_d"))
        .join(caps, keys)
    )

    def effect(cap: Column) -> Column:
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("lo"), cap.alias("hi"))
        return F.aggregate(
            "_d", zero,
            lambda s, d: F.struct(
                (s["a"] + d).alias("a"), _clamp(s["lo"] + d, cap).alias("lo"), _clamp(s["hi"] + d, cap).alias("hi")
            ),
        )

    # All sizes of a block are folded in its one row; only three numbers a size leave it.
    effects = blocks.select(*keys, block, F.posexplode(F.transform("_caps", effect)).alias("_k", "_e"))
    chained = (
        effects.groupBy(*keys, "_k")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(block).alias("b"), F.col("_e").alias("e")))).alias("_c"))
        .select(
            *keys, "_k", F.col("_c.b").alias("_b"),
            F.aggregate(
                "_c", F.array(F.lit(float(start))),
                lambda levels, c: F.concat(
                    levels,
                    F.array(F.greatest(c["e"]["lo"], F.least(c["e"]["hi"], F.element_at(levels, -1) + c["e"]["a"]))),
                ),
            ).alias("_levels"),
        )
        .select(*keys, "_k", F.explode(F.arrays_zip("_b", F.slice("_levels", 1, F.size("_b")).alias("_x"))).alias("_z"))
        .groupBy(*keys, F.col("_z._b").alias(block))
        .agg(F.array_sort(F.collect_list(F.struct("_k", F.col("_z._x").alias("x")))).alias("_starts"))
    )

    def replay(at: Column) -> Column:
        cap = at["cap"]
        return F.aggregate(
            "_d", F.struct(at["x"].alias("x"), F.lit(0.0).alias("up"), F.lit(0.0).alias("down")),
            lambda s, d: F.struct(
                _clamp(s["x"] + d, cap).alias("x"),
                (s["up"] + F.greatest(_clamp(s["x"] + d, cap) - s["x"], F.lit(0.0))).alias("up"),
                (s["down"] + F.greatest(s["x"] - _clamp(s["x"] + d, cap), F.lit(0.0))).alias("down"),
            ),
        )

    begun = F.zip_with("_caps", "_starts", lambda c, s: F.struct(c.alias("cap"), s["x"].alias("x")))
    totals = F.transform(begun, lambda at: F.struct(at["cap"].alias("capacity"), replay(at).alias("t")))
    replayed = blocks.join(chained, [*keys, block]).select(*keys, F.inline(totals))
    return replayed.groupBy(*keys, "capacity").agg(F.sum("t.up").alias("rise"), F.sum("t.down").alias("fall"))
