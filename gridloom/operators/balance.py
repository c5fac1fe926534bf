"""Surplus and shortage probabilities from joint demand and renewable scenarios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import bands
from gridloom.operators import runs
from gridloom.operators.scenarios import WINDOW_KEYS

AT = [*WINDOW_KEYS, "offset"]


def demand_blocks(blocks: DataFrame, demand_store: DataFrame, hours: int) -> DataFrame:
    """The block each scenario takes from the demand store.

    A scenario keeps its generation block where the demand store has those hours without a gap.
    Others take the valid blocks in turn, by scenario number. A window with no valid block keeps
    none, and its demand is held at p50. At most one row per scenario and window is ordered.
    """
    known = demand_store.where(F.col("residual").isNotNull()).select("region", "valid_time")
    good = runs.window_starts(known, ["region"], hours).select("region", F.col("valid_time").alias("block_start"), F.lit(True).alias("_ok"))
    marked = blocks.join(good, ["region", "block_start"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    w = Window.partitionBy(*WINDOW_KEYS)
    valid = marked.where("_ok").select(
        *WINDOW_KEYS, F.col("block_start").alias("_spare"), (F.row_number().over(w.orderBy("scenario")) - 1).alias("_turn")
    )
    counted = marked.withColumn("_n", F.sum(F.col("_ok").cast("int")).over(w))
    turn = F.when(F.col("_n") > 0, F.pmod(F.col("scenario"), F.when(F.col("_n") > 0, F.col("_n"))).cast("int"))
    return (
        counted.withColumn("_turn", turn).join(valid, [*WINDOW_KEYS, "_turn"], "left")
        .select(*WINDOW_KEYS, "scenario", F.when(F.col("_ok"), F.col("block_start")).otherwise(F.col("_spare")).alias("block_start"))
    )


def demand_scenarios(hours: DataFrame, blocks: DataFrame, demand_store: DataFrame, n_hours: int, dispersion: float = 1.0) -> DataFrame:
    """Demand per scenario hour: p50 plus the block's error scaled by the regional peak.

    ``hours`` has ``p50_mw`` and ``peak_mw`` per window hour.
    """
    chosen = demand_blocks(blocks, demand_store, n_hours)
    fan = hours.select(*AT, "p50_mw", "peak_mw").join(chosen, WINDOW_KEYS).withColumn(
        "_at", F.col("block_start") + F.make_dt_interval(hours=F.col("offset").cast("int"))
    )
    errors = demand_store.select("region", F.col("valid_time").alias("_at"), "residual")
    moved = F.col("p50_mw") + F.coalesce("residual", F.lit(0.0)) * F.col("peak_mw") * dispersion
    return fan.join(errors, ["region", "_at"], "left").select(*AT, "scenario", moved.alias("demand_mw"))


def scenario_balance(demand: DataFrame, renewable: DataFrame, headroom: DataFrame) -> DataFrame:
    """Residual of every scenario hour with its surplus and shortage."""
    joined = demand.join(renewable, [*AT, "scenario"]).join(headroom.select("region", "headroom_mw"), "region")
    residual = F.col("demand_mw") - F.col("renewable_mw")
    staged = joined.withColumn("residual_mw", residual)
    r, h = F.col("residual_mw"), F.col("headroom_mw")
    return staged.withColumns({
        "is_surplus": r < 0, "is_shortage": r > h,
        "surplus_mw": F.when(r < 0, -r).otherwise(0.0), "shortage_mw": F.when(r > h, r - h).otherwise(0.0),
    })


def balance_points(members: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """Probabilities, quantiles and magnitudes per hour, counted over scenarios.

    Expected magnitude is probability times conditional magnitude, and stays so after calibration.
    ``maps`` is ``(region, event, knots)``; one row per region after the pivot.
    """
    def quantiles(c: str, *levels: float) -> Column:
        return F.percentile(c, F.array(*[F.lit(x) for x in levels]))

    points = members.groupBy(*AT).agg(
        F.max("valid_time").alias("valid_time"), F.count("*").alias("n_scenarios"),
        F.percentile("demand_mw", F.lit(0.5)).alias("demand_p50_mw"),
        quantiles("renewable_mw", 0.1, 0.5, 0.9).alias("_r"), quantiles("residual_mw", 0.1, 0.5, 0.9).alias("_d"),
        F.avg(F.col("is_surplus").cast("double")).alias("raw_surplus"), F.avg(F.col("is_shortage").cast("double")).alias("raw_shortage"),
        F.coalesce(F.avg(F.when(F.col("is_surplus"), F.col("surplus_mw"))), F.lit(0.0)).alias("conditional_surplus_mw"),
        F.coalesce(F.avg(F.when(F.col("is_shortage"), F.col("shortage_mw"))), F.lit(0.0)).alias("conditional_shortage_mw"),
    )
    for event in ("surplus", "shortage"):
        raw = F.col(f"raw_{event}")
        if maps is None:
            points = points.withColumn(f"p_{event}", raw)
        else:
            table = maps.where(F.col("event") == event).select("region", F.col("knots").alias("_k"))
            points = points.join(table, "region", "left").withColumn(f"p_{event}", bands.map_probability(raw, F.col("_k"))).drop("_k")
        points = points.withColumn(f"expected_{event}_mw", F.col(f"p_{event}") * F.col(f"conditional_{event}_mw"))
    return points.select(
        *AT, "valid_time", (F.col("offset") + 1).alias("horizon_h"), "n_scenarios", "demand_p50_mw",
        *[F.col("_r")[i].alias(f"renewable_{n}_mw") for i, n in enumerate(("p10", "p50", "p90"))],
        *[F.col("_d")[i].alias(f"residual_{n}_mw") for i, n in enumerate(("p10", "p50", "p90"))],
        "p_surplus", "p_shortage", "expected_surplus_mw", "expected_shortage_mw", "conditional_surplus_mw", "conditional_shortage_mw",
        bands.action_label(F.col("p_surplus"), F.col("p_shortage")).alias("recommended_action"),
    )


def outcomes(points: DataFrame, renewable_truth: DataFrame, demand_truth: DataFrame, headroom: DataFrame) -> DataFrame:
    """Points with what happened: residual, and both event flags as 0 or 1."""
    joined = (
        points.join(renewable_truth.select(*AT, F.col("actual_mw").alias("actual_renewable_mw")), AT)
        .join(demand_truth.select("region", "valid_time", F.col("actual_mw").alias("actual_demand_mw")), ["region", "valid_time"])
        .join(headroom.select("region", "headroom_mw"), "region")
    )
    residual = F.col("actual_demand_mw") - F.col("actual_renewable_mw")
    return joined.withColumns({
        "actual_residual_mw": residual, "was_surplus": (residual < 0).cast("double"),
        "was_shortage": (residual > F.col("headroom_mw")).cast("double"),
    })


def all_event_runs(points: DataFrame, *, threshold: float = 0.5) -> DataFrame:
    return runs.event_runs(points, "surplus", threshold=threshold).unionByName(
        runs.event_runs(points, "shortage", threshold=threshold)
    )


def event_scores(scored: DataFrame) -> DataFrame:
    """Long ``(region, event, p, outcome)`` for both events: input to Brier, reliability and maps."""
    both = F.explode(F.array(*[
        F.struct(F.lit(e).alias("event"), F.col(f"p_{e}").alias("p"), F.col(f"was_{e}").alias("outcome")) for e in ("surplus", "shortage")
    ]))
    return scored.select("region", "valid_time", both.alias("_e")).select("region", "valid_time", "_e.*")
