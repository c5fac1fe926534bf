"""Conformal widening, empirical coverage and monotone probability maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import clock
from gridloom.operators.joins import small_map
from gridloom.operators.quantiles import exact_quantiles
from gridloom.session import materialise

COVERAGE = 0.80
MIN_BUCKET_ROWS = 500
MIN_CALIBRATION_ROWS = 200
KNOT_COUNT = 21


def conformity(actual: Column, lower: Column, upper: Column) -> Column:
    """How far the outcome lies outside the band; negative inside."""
    return F.greatest(lower - actual, actual - upper)


def _finite_sample(level: Column, n: Column) -> Column:
    return F.least(F.lit(1.0), F.ceil((n + 1) * level - 1e-9) / n)


def conformal_widening(scores: DataFrame, keys: list[str], *, coverage: float = COVERAGE) -> DataFrame:
    """``(keys, n, widening)``: the finite-sample order statistic of the conformity ``score``.

    Pooled scores are unbounded, so the statistic comes from ``exact_quantiles``.
    """
    found = exact_quantiles(scores, keys, "score", [coverage], method="higher", adjust=_finite_sample, out="widening")
    return found.select(*keys, "n", "widening")


def widening_by_bucket(
    scores: DataFrame, keys: list[str], *, coverage: float = COVERAGE, min_rows: int = MIN_BUCKET_ROWS
) -> DataFrame:
    """Widening per lead bucket with enough rows, plus ``all`` over every row including unbucketed."""
    bucket = clock.lead_bucket(F.col("horizon_h"))
    labels = F.when(bucket == clock.OUT_OF_RANGE, F.array(F.lit("all"))).otherwise(F.array(bucket, F.lit("all")))
    pooled = scores.select(*keys, "score", F.explode(labels).alias("lead_bucket"))
    found = conformal_widening(pooled, [*keys, "lead_bucket"], coverage=coverage)
    return found.where((F.col("lead_bucket") == "all") | (F.col("n") >= min_rows))


def region_shift(frame: DataFrame, *, min_rows: int = MIN_BUCKET_ROWS) -> DataFrame:
    """Median distance of the outcome from the band's midpoint per region; zero with few rows."""
    centred = frame.withColumn("_d", F.col("actual") - (F.col("lower") + F.col("upper")) / 2.0)
    medians = exact_quantiles(centred, ["region"], "_d", [0.5], out="median")
    return medians.select("region", "n", F.when(F.col("n") >= min_rows, F.col("median")).otherwise(0.0).alias("shift"))


def region_calibration(frame: DataFrame, *, coverage: float = COVERAGE, min_rows: int = MIN_BUCKET_ROWS) -> DataFrame:
    """Shift, then widening per bucket around the shifted band. Few rows give zero for both."""
    shifts = materialise(region_shift(frame, min_rows=min_rows))
    shift = F.try_element_at(small_map(shifts, F.col("region"), F.col("shift")), F.col("region"))
    moved = frame.withColumn("shift", shift).withColumn(
        "score", conformity(F.col("actual"), F.col("lower") + F.col("shift"), F.col("upper") + F.col("shift"))
    )
    table = widening_by_bucket(moved, ["region"], coverage=coverage, min_rows=min_rows).drop("n")
    joined = table.join(shifts, "region")
    scarce = F.col("n") < min_rows
    return joined.select(
        "region", "lead_bucket", F.when(scarce, 0.0).otherwise(F.col("widening")).alias("widening"), "shift"
    )


def empirical_coverage(frame: DataFrame, keys: list[str], actual: str, lower: str, upper: str) -> DataFrame:
    inside = (F.col(actual) >= F.col(lower)) & (F.col(actual) <= F.col(upper))
    return frame.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"))


def running_maximum(frame: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frame.withColumn(value, F.max(value).over(w))


def fit_probability_maps(frame: DataFrame, keys: list[str], p: str, outcome: str) -> DataFrame:
    """One isotonic map per key combination (regions x events): ``(keys, knots)``, all keys in one plan.

    Equal probabilities are pooled before any fit. With n scenarios there are at most n + 1 distinct ones, so
    the pairs of points below are bounded and do not grow with the hours. The fit at a point is the greatest,
    over starts at or before it, of the least mean over ends at or after it. With fewer than 200 rows the knots
    are NULL, which maps as identity.
    """
    pooled = frame.groupBy(*keys, F.col(p).cast("double").alias("_p")).agg(F.sum(F.col(outcome).cast("double")).alias("_o"), F.count("*").alias("_n"))
    past = Window.partitionBy(*keys).orderBy("_p")
    points = materialise(pooled.select(*keys, "_p", "_o", "_n", F.sum("_o").over(past).alias("_so"), F.sum("_n").over(past).alias("_sn"), F.row_number().over(past).alias("_i")))
    starts = points.select(*keys, F.col("_i").alias("_j"), (F.col("_so") - F.col("_o")).alias("_bo"), (F.col("_sn") - F.col("_n")).alias("_bn"))
    means = points.join(starts, keys).where("_j <= _i").withColumn("_mean", (F.col("_so") - F.col("_bo")) / (F.col("_sn") - F.col("_bn")))
    least = F.min("_mean").over(Window.partitionBy(*keys, "_j").orderBy(F.desc("_i")))
    fits = means.withColumn("_least", least).groupBy(*keys, "_i", "_p").agg(F.max("_least").alias("_fit"))
    shapes = fits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_p", "_fit"))).alias("_f"))
    shapes = shapes.join(points.groupBy(*keys).agg(F.sum("_n").alias("_rows")), keys)

    def at(g):
        below = F.try_element_at(F.filter("_f", lambda x: x["_p"] <= g), F.lit(-1))
        above = F.try_element_at(F.filter("_f", lambda x: x["_p"] >= g), F.lit(1))
        part = (g - below["_p"]) / (above["_p"] - below["_p"])
        between = F.when(above["_p"] == below["_p"], below["_fit"]).otherwise(below["_fit"] + part * (above["_fit"] - below["_fit"]))
        return F.least(F.greatest(F.coalesce(between, below["_fit"], above["_fit"]), F.lit(0.0)), F.lit(1.0))

    grid = [at(F.lit(i / (KNOT_COUNT - 1))) for i in range(1, KNOT_COUNT - 1)]
    shapes = shapes.withColumn("_y", F.array(F.lit(0.0), *grid, F.lit(1.0)))
    rising = F.transform("_y", lambda _, i: F.array_max(F.slice(F.col("_y"), F.lit(1), i + 1)))
    return shapes.select(*[F.col(k).cast("string").alias(k) for k in keys], F.when(F.col("_rows") >= MIN_CALIBRATION_ROWS, rising).alias("knots"))
