"""Exact order statistics for groups of any size.

``percentile`` keeps every distinct value of a group in one task. That is fine for groups bounded by
a calendar or an ensemble, and not for pooled error scores. ``exact_quantiles`` gives the same numbers
by narrowing a bracket around each wanted rank: a mergeable sketch proposes edges, exact counts say
between which two of them the rank lies, and this is repeated until a bracket holds at most ``bracket``
distinct values, which are then ordered. The sketch affects the number of rounds, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialise

ACCURACY = 10_000
SALTS = 32
#: Distinct values ordered in one task at most, and edges tried in one round.
BRACKET, PROBES = 200_000, 64


def _rank_struct(level: Column, n: Column, method: str) -> Column:
    """The one or two ranks (1-based) and weights that make a quantile."""
    position = (n - 1) * level
    low = F.floor(position)
    if method == "higher":
        # Guard against a position that is whole but for float noise.
        return F.array(F.struct((F.ceil(position - 1e-9) + 1).cast("long").alias("rank"), F.lit(1.0).alias("weight")))
    if method == "share":
        # The least value with a share of at least ``level`` at or below it.
        return F.array(F.struct(F.greatest(F.lit(1), F.ceil(n * level - 1e-9)).cast("long").alias("rank"), F.lit(1.0).alias("weight")))
    if method != "linear":
        raise ValueError(f"unknown quantile method {method}")
    part = position - low
    return F.array(
        F.struct((low + 1).cast("long").alias("rank"), (1.0 - part).alias("weight")),
        F.struct(F.least(low + 2, n).cast("long").alias("rank"), part.alias("weight")),
    )


def exact_quantiles(
    frame: DataFrame,
    keys: list[str],
    value: str,
    levels: list[float],
    *,
    method: str = "linear",
    adjust=None,
    accuracy: int = ACCURACY,
    bracket: int = BRACKET,
    out: str = "quantile",
) -> DataFrame:
    """``(keys, level, n, quantile)`` per group. ``adjust(level, n)`` may move a level by group size.

    ``linear`` interpolates like ``percentile``; ``higher`` takes the next order statistic; ``share`` the least value
    with a share of at least ``level`` of the rows at or below it.
    """
    data = frame.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    # Repeats collapse here, and everything below reads this table: the input itself is read once.
    distinct = materialise(data.groupBy(*keys, "_v").agg(F.count("*").alias("_c")))
    sizes = distinct.groupBy(*keys).agg(F.sum("_c").alias("n"))
    level = adjust(F.col("level"), F.col("n")) if adjust else F.col("level")
    wanted = sizes.select(*keys, "n", F.explode(F.array(*[F.lit(float(q)) for q in levels])).alias("level")).select(
        *keys, "level", "n", F.explode(_rank_struct(level, F.col("n"), method)).alias("_r")
    ).select(*keys, "level", "n", "_r.rank", "_r.weight")
    widest = distinct.groupBy(*keys).agg(F.count("*").alias("_m")).agg(F.max("_m")).first()[0] or 0
    if widest <= bracket:  # every group fits a task: its values are ordered as they are
        past = Window.partitionBy(*keys).orderBy("_v")
        counted = distinct.withColumn("_upto", F.sum("_c").over(past)).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))

        def hit(rank: Column) -> Column:
            return (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_c"))

        def pick(q: Column) -> Column:
            ranks = F.filter(_rank_struct(adjust(q, F.col("n")) if adjust else q, F.col("n"), method), lambda r: hit(r["rank"]))
            weight = F.when(F.size(ranks) > 0, F.aggregate(ranks, F.lit(0.0), lambda acc, r: acc + r["weight"]))
            return F.struct(q.alias("level"), weight.alias("weight"))

        picks = F.filter(F.transform(F.array(*[F.lit(float(q)) for q in levels]), pick), lambda p: p["weight"].isNotNull())
        picked = counted.select(*keys, "_v", "n", F.explode(picks).alias("_p")).select(*keys, "_v", "n", "_p.level", "_p.weight")
        return picked.groupBy(*keys, "level", "n").agg(F.sum(F.col("_v") * F.col("weight")).alias(out))
    # Targets: one row per wanted rank, with the values it still lies between (lo, hi] and the rows at or below lo.
    targets = materialise(wanted.select(
        *keys, "level", "n", "rank", "weight", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(0).cast("long").alias("_skip")
    ))
    while True:
        inside = _spread(distinct, targets, keys)
        counts = inside.groupBy(*keys, "level", "rank").agg(F.count("*").alias("_m"))
        widest = counts.agg(F.max("_m")).first()[0] or 0
        if widest <= bracket:
            break
        # The rank's place inside its bracket as a share of the rows there proposes a narrower one.
        probes = inside.groupBy(*keys, "level", "rank").agg(
            # The mean always has values on both sides, so every round narrows, however poor the sketch.
            F.concat(F.percentile_approx("_v", [i / PROBES for i in range(PROBES + 1)], accuracy), F.array(F.avg("_v"))).alias("_b"),
        )
        cut = targets.join(probes, [*keys, "level", "rank"])
        steps = materialise(cut.select(*keys, "level", "rank", F.explode(F.array_distinct("_b")).alias("_edge")))
        below = _spread(distinct, steps.join(targets, [*keys, "level", "rank"]), keys).where(F.col("_v") <= F.col("_edge"))
        below = below.groupBy(*keys, "level", "rank", "_edge").agg(F.sum("_c").alias("_upto"), F.max("_skip").alias("_s"))
        edges = below.select(*keys, "level", "rank", "_edge", (F.col("_upto") + F.col("_s")).alias("_upto"))
        edges = edges.groupBy(*keys, "level", "rank").agg(
            F.max(F.when(F.col("_upto") < F.col("rank"), F.col("_edge"))).alias("_lo"),
            F.max(F.when(F.col("_upto") < F.col("rank"), F.col("_upto"))).alias("_low_skip"),
            F.min(F.when(F.col("_upto") >= F.col("rank"), F.col("_edge"))).alias("_hi"),
        )
        targets = materialise(targets.join(edges, [*keys, "level", "rank"], "left").select(
            *keys, "level", "n", "rank", "weight",
            F.coalesce("_lo", "lo").alias("lo"), F.coalesce("_hi", "hi").alias("hi"), F.coalesce("_low_skip", "_skip").alias("_skip"),
        ))
    w = Window.partitionBy(*keys, "level", "rank").orderBy("_v")
    counted = inside.withColumn("_upto", F.sum("_c").over(w) + F.col("_skip"))
    chosen = counted.where((F.col("_upto") >= F.col("rank")) & (F.col("_upto") - F.col("_c") < F.col("rank")))
    # With linear weights both ranks may be one row (n = 1); weights then still sum to one.
    return chosen.groupBy(*keys, "level", "n").agg(F.sum(F.col("_v") * F.col("weight")).alias(out))


def _spread(distinct: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values inside the bracket of each target. The join is salted by value, so that a group with
    most of the rows is many tasks."""
    salted = distinct.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    copies = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt").where((F.col("_v") > F.col("lo")) & (F.col("_v") <= F.col("hi")))
