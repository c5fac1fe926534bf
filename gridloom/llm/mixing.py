"""Mixing sources to target weights by temperature, in column expressions only.

A source's weight is its share of all words to the power ``alpha``, normalised. The smallest ``alpha`` in [0, 1]
is taken whose mixture reads no source more than ``max_epochs`` times and, where ``entropy`` is given, is no
flatter than that entropy (in nats). Both fall as ``alpha`` rises, so it is found by bisection; one Spark
aggregate evaluates all the points of several halvings at once.

The weights are realised by permuting each source in blocks: a document's place is a 60-bit hash, blocks are its
leading bits. Whole epochs take every document; the rest of a source's budget takes blocks in order, then smaller
blocks inside the one that does not fit whole, down to single places. No source is sorted or gathered in a task.

With no ``budget`` the smallest one is taken that reads every document at least once. Null text: no words. Null
source: a source of its own. A source without words has no weight: its documents are taken once without a
budget, else never. Rows of equal doc_id have one place and are taken together. Empty input: no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import materialise

#: Points evaluated at once (four halvings) and rounds of them: alpha to 1 / 2^24.
POINTS, ROUNDS = 15, 6
LEVEL_BITS, LEVELS = 10, 3


def placed(docs: DataFrame, key: str, source: str, text: str, seed: int) -> DataFrame:
    """Key, source, n_tokens (words) and place (60 bits) of each document."""
    return docs.select(
        F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 4).alias("place"),
    )


def measured(totals: DataFrame, alphas: list[float]) -> dict[float, tuple[float, float, float, float]]:
    """(Z, sum of p^a ln p, greatest and least p^(a-1)) of each alpha, in one aggregate over the sources."""
    rows = totals.select("p", F.explode(F.array(*map(F.lit, alphas))).alias("a"))
    power = F.exp(F.col("a") * F.log("p"))
    rows = rows.groupBy("a").agg(
        F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("s"), F.max(power / F.col("p")).alias("hi"), F.min(power / F.col("p")).alias("lo")
    )
    return {r["a"]: (r["z"], r["s"], r["hi"], r["lo"]) for r in rows.collect()}


def exponent(totals: DataFrame, total: float, budget: float | None, max_epochs: float, entropy: float | None) -> tuple[float, float]:
    """The exponent and the budget in words."""
    from math import log

    def fits(values: tuple[float, float, float, float], alpha: float) -> bool:
        z, s, hi, lo = values
        epochs = hi / lo if budget is None else budget / total * hi / z
        return epochs <= max_epochs * (1 + 1e-12) and (entropy is None or log(z) - alpha * s / z <= entropy)

    ends = measured(totals, [0.0, 1.0])
    low, high = 0.0, 1.0
    if fits(ends[0.0], 0.0):
        high, found = 0.0, ends[0.0]
    else:
        found = ends[1.0]
        for _ in range(ROUNDS):
            step = (high - low) / (POINTS + 1)
            points = [low + step * (i + 1) for i in range(POINTS)]
            values = measured(totals, points)
            good = [p for p in points if fits(values[p], p)]
            if good:
                high, found = good[0], values[good[0]]
            low = max([low, *[p for p in points if p < high]])
    z, _, _, lo = found
    return high, total * z / lo if budget is None else budget


def cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, cut): the last place of each source whose documents up to it hold at most ``rest`` words.

    Each level counts words by block inside the block that the level before could not take whole.
    """
    state = wanted.select("source", "rest", F.lit(0).cast("long").alias("block"))
    for level in range(1, LEVELS + 1):
        shift = 60 - LEVEL_BITS * level
        inside = F.shiftright("place", shift + LEVEL_BITS) == F.col("block")
        parts = rows.join(state, "source").where(inside).groupBy("source", "rest", F.shiftright("place", shift).alias("part")).agg(F.sum("n_tokens").alias("n"))
        past = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
        parts = parts.withColumn("past", past).where("past > rest")
        state = materialise(parts.groupBy("source").agg(
            F.min("part").alias("block"), F.min_by(F.col("rest") - (F.col("past") - F.col("n")), "part").alias("rest")
        ))
    shift = 60 - LEVEL_BITS * LEVELS
    last = rows.join(state, "source").where(F.shiftright("place", shift) == F.col("block"))
    last = last.groupBy("source", "block", "rest", "place").agg(F.sum("n_tokens").alias("n"))
    past = F.sum("n").over(Window.partitionBy("source").orderBy("place"))
    fit = last.withColumn("past", past).where("past <= rest").groupBy("source").agg(F.max("place").alias("fit"))
    # Everything before the block fits; inside it, up to the last place that does.
    return state.join(fit, "source", "left").select("source", F.coalesce("fit", F.shiftleft("block", shift) - 1).alias("cut"))


def mixture(
    docs: DataFrame, budget: float | None = None, max_epochs: float = 4.0, entropy: float | None = None,
    key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 11,
) -> DataFrame:
    """Key, source, n_tokens, weight of the source, copies (times the document is read) and block of each document."""
    if max_epochs < 1:
        raise ValueError("max_epochs must be 1 or more")
    rows = placed(docs, key, source, text, seed)
    rows = materialise(rows.withColumn("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("?"))))
    totals = materialise(rows.groupBy("source").agg(F.sum("n_tokens").alias("words")))
    total = totals.agg(F.sum("words")).first()[0] or 0
    if budget is not None and total:
        budget = min(float(budget), max_epochs * total)
    once = F.lit(1 if budget is None else 0).cast("long")
    if total:
        shares = totals.where("words > 0").withColumn("p", F.col("words") / F.lit(float(total)))
        alpha, budget = exponent(shares, float(total), budget, max_epochs, entropy)
        power = F.exp(F.lit(alpha) * F.log("p"))
        z = shares.agg(F.sum(power)).first()[0]
        wanted = shares.select("source", "words", (power / F.lit(z)).alias("weight"))
        epochs = F.col("weight") * F.lit(float(budget)) / F.col("words")
        # Exact multiples come out a few bits low or high.
        epochs = F.when(F.abs(epochs - F.round(epochs)) < 1e-9, F.round(epochs)).otherwise(epochs)
        wanted = wanted.withColumn("full", F.floor(epochs)).withColumn("rest", F.floor((epochs - F.floor(epochs)) * F.col("words")))
        wanted = materialise(wanted)
        plan = materialise(wanted.join(cuts(rows, wanted), "source", "left"))
        rows = rows.join(plan.select("source", "weight", "full", "cut"), "source", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("double").alias("weight"), F.lit(None).cast("long").alias("full"), F.lit(None).cast("long").alias("cut"))
    copies = F.coalesce(F.col("full") + F.coalesce((F.col("place") <= F.col("cut")).cast("long"), F.lit(0)), once)
    return rows.select(
        F.col("key").alias(key), F.when(F.col("source") != "?", F.substring("source", 2, 1 << 30)).alias(source), "n_tokens",
        F.coalesce("weight", F.lit(0.0)).alias("weight"), copies.alias("copies"), F.shiftright("place", 50).alias("block"),
    )
