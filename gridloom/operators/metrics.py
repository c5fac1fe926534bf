"""Forecast metrics, baselines and skill as single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import clock

LEVELS = {"p10_mw": 0.1, "p50_mw": 0.5, "p90_mw": 0.9}
CLEAR_CAP = 1.3


def pinball(actual: Column, predicted: Column, level: float) -> Column:
    gap = actual - predicted
    return F.greatest(gap * level, gap * (level - 1.0))


def metric_columns(actual: str, predicted: str, capacity: str) -> list[Column]:
    """n, nMAE, nRMSE and bias in percent of capacity, and R2."""
    y, p, c = F.col(actual), F.col(predicted), F.col(capacity)
    gap = p - y
    sse = F.sum(gap * gap)
    spread = F.var_pop(y) * F.count(y)
    return [
        F.count("*").alias("n"),
        (F.avg(F.abs(gap) / c) * 100.0).alias("nmae_pct"),
        (F.sqrt(F.avg((gap / c) * (gap / c))) * 100.0).alias("nrmse_pct"),
        (F.avg(gap / c) * 100.0).alias("bias_pct"),
        F.when(spread > 0, 1.0 - sse / F.when(spread > 0, spread)).alias("r2"),
    ]


def band_columns(actual: str = "actual_mw", capacity: str = "capacity_mw") -> list[Column]:
    """Coverage and mean width of the p10-p90 band, and mean pinball loss."""
    y, c = F.col(actual), F.col(capacity)
    inside = (y >= F.col("p10_mw")) & (y <= F.col("p90_mw"))
    losses = [F.avg(pinball(y / c, F.col(p) / c, q)) for p, q in LEVELS.items()]
    return [
        F.avg(inside.cast("double")).alias("coverage"),
        F.avg((F.col("p90_mw") - F.col("p10_mw")) / c).alias("mean_width"),
        ((losses[0] + losses[1] + losses[2]) / 3.0).alias("pinball"),
    ]


def score(frame: DataFrame, keys: list[str], predicted: str = "p50_mw") -> DataFrame:
    return frame.groupBy(*keys).agg(*metric_columns("actual_mw", predicted, "capacity_mw"))


def score_with_total(frame: DataFrame, key: Column, name: str, predicted: str = "p50_mw") -> DataFrame:
    """Metrics per key value plus an ``all`` row, by rollup: one scan, one shuffle of partials."""
    keyed = frame.withColumn(name, key)
    rolled = keyed.rollup(name).agg(
        F.grouping(name).alias("_g"), *metric_columns("actual_mw", predicted, "capacity_mw"), *band_columns()
    )
    return rolled.withColumn(name, F.when(F.col("_g") == 1, "all").otherwise(F.col(name))).drop("_g")


def by_lead_bucket(frame: DataFrame, predicted: str = "p50_mw") -> DataFrame:
    return score_with_total(frame, clock.lead_bucket(F.col("horizon_h")), "lead_bucket", predicted)


def score_methods(frame: DataFrame, methods: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Metrics of several prediction columns on the same rows: ``(method, keys, metrics)``.

    Rows are unpivoted inline, so the table is scanned once for all methods.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).alias("predicted")) for m, c in methods.items()]))
    long = frame.select(*(keys or []), "actual_mw", "capacity_mw", pairs.alias("_m")).select(
        *(keys or []), "actual_mw", "capacity_mw", "_m.method", "_m.predicted"
    )
    return long.groupBy("method", *(keys or [])).agg(*metric_columns("actual_mw", "predicted", "capacity_mw"))


def with_skill(scores: DataFrame, reference: str, keys: list[str] | None = None, metric: str = "nmae_pct") -> DataFrame:
    """1 - metric / reference metric; NULL where the reference is not positive.

    The score table holds one row per method and key, so the window sees a handful of rows.
    """
    reference_value = F.max(F.when(F.col("method") == reference, F.col(metric))).over(Window.partitionBy(*(keys or [])))
    staged = scores.withColumn("_ref", reference_value)
    positive = F.when(F.col("_ref") > 0, F.col("_ref"))
    return staged.withColumn("skill", 1.0 - F.col(metric) / positive).drop("_ref")


def climatology(train: DataFrame, value: str = "actual_mw") -> tuple[DataFrame, DataFrame]:
    """Mean per (site, 15-day block, hour) and per site, from training rows only."""
    keyed = train.withColumns({"doy_block": clock.day_bin(F.col("valid_time"), 15), "hour": F.hour("valid_time")})
    cells = keyed.groupBy("site_id", "doy_block", "hour").agg(F.avg(value).alias("mean_mw"))
    return cells, train.groupBy("site_id").agg(F.avg(value).alias("mean_mw"))


def smart_persistence(power_at_issue: Column, clear_at_issue: Column, clear: Column, tech: Column) -> Column:
    """Hold the clear-sky index of the issue hour (clipped to 0 .. 1.3); wind holds its power."""
    index = F.when(clear_at_issue > 1e-6, power_at_issue / F.when(clear_at_issue > 1e-6, clear_at_issue)).otherwise(0.0)
    held = F.least(F.greatest(index, F.lit(0.0)), F.lit(CLEAR_CAP)) * clear
    return F.when(tech == "wind", power_at_issue).otherwise(held)


def site_spread(scores: DataFrame, metric: str = "nmae_pct") -> DataFrame:
    """Min, median, p90 and max over per-site scores; one row per site is the dimension's size."""
    q = F.percentile(metric, F.array(F.lit(0.5), F.lit(0.9)))
    return scores.agg(
        F.count("*").alias("sites"), F.min(metric).alias("lowest"), q[0].alias("median"), q[1].alias("p90"), F.max(metric).alias("highest")
    )


def compare_models(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Two models on identical rows, by lead bucket: both errors and the gain in points."""
    rows = current.select(*keys, "actual_mw", "capacity_mw", F.col("p50_mw").alias("_a")).join(
        baseline.select(*keys, F.col("p50_mw").alias("_b")), keys
    )
    c = F.col("capacity_mw")
    return (
        rows.groupBy(clock.lead_bucket(F.col("horizon_h")).alias("lead_bucket"))
        .agg(
            F.count("*").alias("n"),
            (F.avg(F.abs(F.col("_a") - F.col("actual_mw")) / c) * 100).alias("current_nmae"),
            (F.avg(F.abs(F.col("_b") - F.col("actual_mw")) / c) * 100).alias("baseline_nmae"),
        )
        .withColumn("gain_pp", F.col("baseline_nmae") - F.col("current_nmae"))
    )


def holdout_mismatch(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """Sites held out by one model and not by the other; empty when the comparison is fair."""
    a, b = current.select("site_id").distinct(), baseline.select("site_id").distinct()
    return a.join(b, "site_id", "left_anti").withColumn("only_in", F.lit("current")).unionByName(
        b.join(a, "site_id", "left_anti").withColumn("only_in", F.lit("baseline"))
    )


def brier(frame: DataFrame, keys: list[str], p: str, outcome: str) -> DataFrame:
    """Brier score, its climatology and skill; NULL skill where the event never (or always) occurred."""
    o = F.col(outcome)
    base = F.avg(o)
    stats = frame.groupBy(*keys).agg(
        F.count("*").alias("n"), base.alias("base_rate"), F.avg((F.col(p) - o) * (F.col(p) - o)).alias("brier")
    )
    clim = F.col("base_rate") * (1.0 - F.col("base_rate"))
    return stats.withColumn("brier_climatology", clim).withColumn(
        "skill", F.when(F.col("brier_climatology") >= 1e-9, 1.0 - F.col("brier") / F.col("brier_climatology"))
    )


def reliability(frame: DataFrame, keys: list[str], p: str, outcome: str, bins: int = 5) -> DataFrame:
    index = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return frame.groupBy(*keys, index.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(outcome).alias("observed")
    )


def band_kpis(points: DataFrame, keys: list[str]) -> DataFrame:
    """Window figures: likely surplus and shortage hours, energies, share of known outcomes the band
    held, and the hours with the highest surplus probability and demand (earliest of equals)."""
    actual = F.col("actual_renewable_mw")
    inside = (actual >= F.col("renewable_p10_mw")) & (actual <= F.col("renewable_p90_mw"))
    early = -F.unix_seconds("valid_time")
    return points.groupBy(*keys).agg(
        F.count_if(F.col("p_surplus") >= 0.5).alias("surplus_hours"),
        F.count_if(F.col("p_shortage") >= 0.5).alias("shortage_hours"),
        F.sum("expected_surplus_mw").alias("surplus_mwh"),
        F.sum("expected_shortage_mw").alias("shortage_mwh"),
        F.avg(inside.cast("double")).alias("held_share"),
        F.max_by("valid_time", F.struct(F.round("p_surplus", 9), early)).alias("peak_surplus_hour"),
        F.max_by("valid_time", F.struct(F.round("demand_p50_mw", 6), early)).alias("peak_hour"),
    )
