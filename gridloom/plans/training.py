"""Learned quantile bands: training, scoring, evaluation frames, cross-validation and reports.

Each of p10, p50 and p90 is boosted on its own pinball loss by the features (``operators.boosting``), cut at its best
round on the validation block, sorted per row, then moved by the conformal step on held-out sites. All levels, and in
cross-validation all folds, grow in the same passes over one written table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import bands, clock, solar
from gridloom.operators import boosting, calibration, contracts, features, joins, metrics, splits
from gridloom.session import materialise

LEVELS = [0.1, 0.5, 0.9]
BOOKKEEPING = ("site_id", "region", "tech", "valid_time", "issue_time", "power_mw", "denominator_mw", "target", "split", "clearsky_mw")
ROLES = {"train": boosting.TRAIN, "val": boosting.VALID, "calib": boosting.CALIB}


@dataclass
class BandModel:
    """Boosted quantiles with their feature order, and a widening table."""

    trees: boosting.Ensemble
    feature_order: list[str]
    widening: DataFrame

    def importances(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.trees.gains().items()), "feature string, gain double")

    def save(self, path: str) -> None:
        spark = self.widening.sparkSession
        self.trees.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.trees.to_json(),)], "model string").coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
        self.widening.write.mode("overwrite").parquet(f"{path}/widening")

    @classmethod
    def load(cls, spark: SparkSession, path: str, feature_order: list[str]) -> "BandModel":
        trees = boosting.Ensemble.from_json(spark.read.parquet(f"{path}/model").first()["model"])
        return cls(trees, feature_order, spark.read.parquet(f"{path}/widening"))


def feature_names(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in BOOKKEEPING]


def _learnable(frame: DataFrame, names: list[str], label: str) -> DataFrame:
    """Rows with a known label, a role and every feature."""
    known = features.complete_rows(frame.where(F.col(label).isNotNull()), names)
    return known if label == "target" else known.withColumn("target", F.col(label))


def with_raw_band(frame: DataFrame, trees: boosting.Ensemble, group: Column | None = None) -> DataFrame:
    """p10, p50, p90 in target units, sorted, for the rows that have every feature."""
    scored = boosting.predicted(features.complete_rows(frame, trees.names), trees, "_q", group)
    q = [F.get("_q", F.lit(i)) for i in range(3)]
    return scored.withColumns({c: x for c, x in zip(("p10", "p50", "p90"), bands.sorted_band(*q))}).drop("_q")


def train_bands(
    frame: DataFrame, names: list[str], *, label: str = "target", rounds: int = 100, depth: int = 7, step: float = 0.1
) -> BandModel:
    """Fit on ``split`` = train, best round on val, widening on calib."""
    by_region = "region" in frame.columns
    rows = _learnable(frame.where(F.col("split").isin(*ROLES)), names, label)
    role = F.coalesce(*[F.when(F.col("split") == k, v) for k, v in ROLES.items()], F.lit(boosting.IDLE))
    kept = [*names, *[c for c in ("horizon_h", "split", "region") if c in rows.columns and c not in names]]
    data = materialise(rows.select("target", F.array(role).alias("roles"), *kept))
    trees = boosting.fit(data, names, LEVELS, rounds=rounds, depth=depth, step=step)
    banded = materialise(with_raw_band(data.where("split = 'calib'"), trees).drop(*[n for n in names if n != "horizon_h"]))
    scores = banded.withColumn("score", calibration.conformity(F.col("target"), F.col("p10"), F.col("p90")))
    if by_region:
        widening = calibration.region_calibration(
            banded.select("region", "horizon_h", F.col("target").alias("actual"), F.col("p10").alias("lower"), F.col("p90").alias("upper"))
        )
    else:
        widening = calibration.widening_by_bucket(scores, [])
    return BandModel(trees, names, materialise(widening))


def _widened(raw: DataFrame, widening: DataFrame, keys: list[str]) -> DataFrame:
    """The raw band widened by bucket, the median kept inside, denormalised and clamped, in MW."""
    widened = joins.widening_lookup(raw, widening, keys)
    lower, upper = bands.widen(F.col("p10"), F.col("p90"), F.col("widening"))
    moved = widened.withColumns({"_lo": lower, "_hi": upper})
    lo, hi = bands.keep_median_inside(F.col("_lo"), F.col("p50"), F.col("_hi"))
    staged = moved.withColumns({"p10": lo, "p90": hi}).drop("_lo", "_hi")
    cap = F.col("denominator_mw")
    clear = F.col("clearsky_mw") if "clearsky_mw" in raw.columns else None
    return staged.withColumns({f"{q}_mw": solar.denormalise(F.col(q), cap, cap, clear) for q in ("p10", "p50", "p90")}).drop("p10", "p50", "p90")


def score_bands(frame: DataFrame, model: BandModel) -> DataFrame:
    """Quantile bands of a feature table in MW: align, score, sort, widen by bucket, keep the median
    inside, denormalise and clamp. ``frame`` carries ``denominator_mw`` and, for solar,
    ``clearsky_mw``."""
    contracts.align_features(frame, model.feature_order)
    return _widened(with_raw_band(frame, model.trees), model.widening, [])


def score_demand(frame: DataFrame, model: BandModel) -> DataFrame:
    """Demand bands: shift all three, widen per region and bucket without a floor, scale by peak."""
    raw = with_raw_band(frame, model.trees)
    shifts = model.widening.groupBy("region").agg(F.max("shift").alias("shift"))
    known = joins.small_map(shifts, F.col("region"), F.col("shift"))
    widened = joins.widening_lookup(raw, model.widening, ["region"]).withColumn("shift", F.try_element_at(known, F.col("region")))
    s = F.coalesce("shift", F.lit(0.0))
    lower, upper = bands.widen(F.col("p10") + s, F.col("p90") + s, F.col("widening"), floor=None)
    mid = F.col("p50") + s
    lo, hi = bands.keep_median_inside(lower, mid, upper)
    peak = F.col("region_peak_mw")
    return widened.select(
        "region", "valid_time", "horizon_h", "split", (lo * peak).alias("p10_mw"), (mid * peak).alias("p50_mw"), (hi * peak).alias("p90_mw"),
        (F.col("target") * peak).alias("actual_mw"), peak.alias("capacity_mw"),
    )


def wind_dataset(weather: DataFrame, power: DataFrame, sites: DataFrame, seed: int = 42, columns: list[str] | None = None) -> DataFrame:
    """Wind features (all, or ``columns`` of the table), target and split for all sites.

    The split looks at all sites and times, so the table is written first, and the groups of its sites after it.
    """
    assembled = features.assemble_target(features.wind_features(weather, sites), power, sites)
    table = materialise(assembled.select(*columns) if columns else assembled)
    return splits.make_split(table, seed, materialise(splits.site_groups(table, seed)))


def solar_dataset(weather: DataFrame, power: DataFrame, sites: DataFrame, seed: int = 42) -> DataFrame:
    table = features.solar_features(weather, sites)
    assembled = features.assemble_target(table, power, sites)
    clear = (F.col("clearsky_cf") * F.col("denominator_mw")).alias("clearsky_mw")
    return splits.make_split(assembled.select("*", clear), seed)


def demand_dataset(market: DataFrame, centre: DataFrame, zones: dict[str, str], horizons: tuple[int, ...], regions: list[str]) -> DataFrame:
    """Demand features normalised by regional peak, one-hot regions, four time blocks."""
    table = features.demand_features(market, centre, zones, horizons)
    peaked = table.join(features.region_peaks(market), "region")
    shaped = peaked.withColumns({"target": F.col("target") / F.col("peak_mw"), "region_peak_mw": F.col("peak_mw")}).drop("peak_mw")
    return splits.time_blocks(shaped.select("*", *features.one_hot("region", regions, "region_")))


def seasonal_naive(demand: DataFrame) -> DataFrame:
    """Demand at the same hour last week: joined at valid time minus 168 h, legal at every lead."""
    week = demand.select("region", (F.col("valid_time") + F.expr("interval 168 hours")).alias("valid_time"), F.col("demand_mw").alias("naive_mw"))
    return demand.join(week, ["region", "valid_time"], "left")


def evaluation_frame(scored: DataFrame, measured: DataFrame, physics: DataFrame, holdout: float = 0.2) -> DataFrame:
    """Predictions with truth, physical estimate, state at issue and a time holdout flag.

    ``measured`` has ``power_mw`` and ``clearsky_mw`` per (site, hour); ``physics`` has
    ``physics_mw`` per (site, hour, lead).
    """
    base = scored.join(physics, ["site_id", "valid_time", "horizon_h"], "left")
    state = joins.value_at_issue(base, measured, {"power_mw": "power_at_issue_mw", "clearsky_mw": "clearsky_at_issue_mw"}, ["power_mw"])
    return splits.holdout_split(state, holdout)


def with_baselines(frame: DataFrame) -> DataFrame:
    """Persistence, smart persistence and climatology columns; climatology from the training side."""
    train = frame.where(~F.col("is_holdout"))
    cells, means = metrics.climatology(train)
    keyed = frame.withColumns({"doy_block": clock.day_bin(F.col("valid_time"), 15), "hour": F.hour("valid_time")})
    smart = metrics.smart_persistence(F.col("power_at_issue_mw"), F.col("clearsky_at_issue_mw"), F.col("clearsky_mw"), F.col("tech"))
    return joins.with_fallback(keyed, cells, ["site_id", "doy_block", "hour"], means).withColumns(
        {"persistence_mw": F.col("power_at_issue_mw"), "smart_mw": smart}
    )


METHODS = {
    "model": "p50_mw", "persistence": "persistence_mw", "smart_persistence": "smart_mw", "climatology": "climatology_mw", "physics_only": "physics_mw",
}


def benchmark_report(frame: DataFrame, methods: dict[str, str] = METHODS) -> DataFrame:
    """Every method on the holdout rows, by lead bucket and overall, with skill over persistence."""
    rows = frame.where("is_holdout").withColumn("lead_bucket", F.explode(F.array(clock.lead_bucket(F.col("horizon_h")), F.lit("all"))))
    scored = metrics.score_methods(rows, methods, ["lead_bucket"])
    return metrics.with_skill(scored, "persistence", ["lead_bucket"])


CALIB_SEED, CALIB_SHARE, FOLD_VAL = 7, 4, 0.125


def fold_roles(keyed: DataFrame, k: int) -> DataFrame:
    """``keyed`` (with ``fold``) with ``roles``, one a fold: rows of the fold itself are idle.

    Of the other folds' sites every fourth, by hash, calibrates; of the rest the last eighth of the time of all the
    other folds stops the fit. The cut times are ``k`` numbers.
    """
    t = F.unix_micros("valid_time")
    spans = {r.fold: (r.lo, r.hi) for r in keyed.groupBy("fold").agg(F.min(t).alias("lo"), F.max(t).alias("hi")).collect() if r.lo is not None}
    cuts = {}
    for g in range(k):
        if ends := [s for f, s in spans.items() if f != g]:
            lo, hi = min(a for a, _ in ends), max(b for _, b in ends)
            cuts[g] = lo + (hi - lo) * (1.0 - FOLD_VAL)
    calib = F.conv(F.substring(splits.seeded(F.col("site_id"), CALIB_SEED), 1, 1), 16, 10).cast("int") % CALIB_SHARE == 0
    learn = F.when(F.col("_calib"), boosting.CALIB)
    roles = [F.when(F.col("fold") == g, boosting.IDLE).otherwise(F.coalesce(learn, F.when(t > F.lit(cuts.get(g, 0.0)), boosting.VALID).otherwise(boosting.TRAIN))) for g in range(k)]
    # The hash is worked out once a row, not once a fold.
    return keyed.withColumn("_calib", calib).withColumn("roles", F.array(*roles)).drop("_calib")


def leave_sites_out(frame: DataFrame, names: list[str], k: int, *, rounds: int = 100, depth: int = 7, step: float = 0.1) -> DataFrame:
    """Site-fold cross-validation: the models of all folds grow in the same passes, and all sites are scored in one.

    A fold's models never saw its sites, neither to learn, to stop nor to calibrate.
    """
    folds = materialise(splits.site_folds(materialise(frame.select("site_id").distinct()), k))
    keyed = features.complete_rows(frame.drop("split").join(folds, "site_id"), names)
    data = materialise(fold_roles(keyed, k))
    trees = boosting.fit(data.where("target IS NOT NULL"), names, LEVELS, groups=k, rounds=rounds, depth=depth, step=step)
    held = data.where("target IS NOT NULL").withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    held = with_raw_band(held.where(F.get("roles", F.col("of")) == boosting.CALIB), trees, F.col("of"))
    scores = held.select(F.col("of").alias("fold"), "horizon_h", calibration.conformity(F.col("target"), F.col("p10"), F.col("p90")).alias("score"))
    widening = materialise(calibration.widening_by_bucket(materialise(scores), ["fold"]))
    return _widened(with_raw_band(data.drop("roles"), trees, F.col("fold")), widening, ["fold"])
