"""Site balance, schedules, growth plans, budget scenarios and policy costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS_PER_YEAR = 8760
ACTION_FLOOR = 0.05
# Unit costs, yields and the five mixes of the budget comparison.
SOLAR_COST, WIND_COST, STORAGE_COST = 4.5, 6.0, 1.6
SOLAR_YIELD, WIND_YIELD = 0.19, 0.30
RUNNING_COST_SHARE = 0.015
REVENUE_PER_GWH = 0.3
MIXES = (
    ("A", "100 % Solar", 1.0, 0.0, 0.0),
    ("B", "Solar + Storage", 0.78, 0.0, 0.22),
    ("C", "Wind + Storage", 0.0, 0.78, 0.22),
    ("D", "Solar + Wind", 0.55, 0.45, 0.0),
    ("E", "Hybrid + Storage", 0.40, 0.36, 0.24),
)


def site_balance(points: DataFrame, keys: list[str]) -> DataFrame:
    """Hour-by-hour storage dispatch of one forecast: net, action, stored, curtailed, unmet, level.

    ``points`` carries ``gen_mw, demand_mw`` per hour and ``power_mw, energy_mwh, start_mwh`` per
    forecast. A forecast holds at most 72 hours, so its ordered fold is a small array in one row;
    forecasts run in parallel.
    """
    item = F.struct("valid_time", F.round(F.col("gen_mw") - F.col("demand_mw"), 2).alias("net"))
    packed = points.groupBy(*keys).agg(
        F.array_sort(F.collect_list(item)).alias("_p"), F.max("power_mw").alias("_pw"), F.max("energy_mwh").alias("_e"),
        F.max("start_mwh").alias("_s"),
    )
    zero = F.lit(0.0)

    def step(levels: Column, p: Column) -> Column:
        level = F.element_at(levels, -1)
        charge = F.least(p["net"], F.col("_pw"), F.col("_e") - level)
        discharge = F.least(-p["net"], F.col("_pw"), level)
        return F.concat(levels, F.array(level + F.when(p["net"] >= 0, charge).otherwise(-discharge)))

    levels = F.aggregate("_p", F.array(F.col("_s").cast("double")), step)
    rows = packed.withColumn("_l", levels).select(
        *keys, F.posexplode(F.arrays_zip("_p", F.slice("_l", 1, F.size("_p")).alias("a"), F.slice("_l", 2, F.size("_p")).alias("b"))).alias("i", "_z")
    )
    net, before, after = F.col("_z._p.net"), F.col("_z.a"), F.col("_z.b")
    moved = after - before
    surplus = net >= 0
    return rows.select(
        *keys, "i", F.col("_z._p.valid_time").alias("valid_time"), net.alias("net"),
        F.when(surplus, "surplus").otherwise("shortage").alias("state"),
        F.when(F.abs(moved) <= ACTION_FLOOR, "hold").when(surplus, "charge").otherwise("discharge").alias("action"),
        F.when(surplus, moved).otherwise(zero).alias("stored"),
        F.when(surplus, zero).otherwise(-moved).alias("discharged"),
        F.when(surplus, F.round(net - moved, 2)).otherwise(zero).alias("curtailed"),
        F.when(surplus, zero).otherwise(F.round(-net + moved, 2)).alias("unmet"),
        before.alias("level_before"), after.alias("level"),
    )


def balance_totals(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Totals of a site balance with its verdict."""
    surplus = F.col("state") == "surplus"
    totals = hours.groupBy(*keys).agg(
        F.count("*").alias("hours"), F.count_if(surplus).alias("surplus_hours"), F.count_if(~surplus).alias("shortage_hours"),
        F.sum(F.when(surplus, F.col("net")).otherwise(0.0)).alias("surplus_energy"),
        F.sum(F.when(surplus, 0.0).otherwise(-F.col("net"))).alias("shortage_energy"),
        F.sum("stored").alias("charge_energy"), F.sum("curtailed").alias("curtail_energy"), F.sum("unmet").alias("unmet_energy"),
        F.min(F.when(~surplus, F.col("net"))).alias("worst_shortage"), F.max(F.when(surplus, F.col("net"))).alias("worst_surplus"),
        (100.0 * F.count_if(F.col("unmet") <= 0) / F.count("*")).alias("demand_met_pct"),
    )
    verdict = (
        F.when(F.col("unmet_energy") > 0.5, "shortage")
        .when(F.col("surplus_hours") / F.col("hours") > 0.35, "surplus").otherwise("balanced")
    )
    return totals.withColumn("verdict", verdict)


def schedule_checks(hours: DataFrame, keys: list[str]) -> tuple[DataFrame, list[tuple[str, Column]]]:
    """A schedule with its lagged level, and the predicates every hour must satisfy.

    Expects ``power_mw`` and ``energy_mwh`` on each row.
    """
    w = Window.partitionBy(*keys).orderBy("i")
    staged = hours.withColumn("_prev", F.lag("level").over(w))
    eps = 1e-6
    return staged, [
        ("power_limit", (F.col("stored") <= F.col("power_mw") + eps) & (F.col("discharged") <= F.col("power_mw") + eps)),
        ("energy_bounds", (F.col("level") >= -eps) & (F.col("level") <= F.col("energy_mwh") + eps)),
        ("no_simultaneous", ~((F.col("stored") > eps) & (F.col("discharged") > eps))),
        ("level_continuity", F.abs(F.col("level") - F.coalesce("_prev", "level_before") - F.col("stored") + F.col("discharged")) <= 1e-4),
    ]


def growth_plan(regions: DataFrame, *, years: int = 5) -> DataFrame:
    """Demand compounding from ``peak_mw`` at ``growth`` against fixed ``renewable_mw``."""
    k = F.explode(F.sequence(F.lit(0), F.lit(years - 1))).alias("k")
    out = regions.select("*", k).withColumn("demand_mw", F.round(F.col("peak_mw") * F.pow(1.0 + F.col("growth"), F.col("k")), 0))
    out = out.withColumns({"year": F.col("start_year") + F.col("k"), "gap_mw": F.round(F.col("demand_mw") - F.col("renewable_mw"), 0)})
    return out.select("region", "year", "demand_mw", "renewable_mw", "gap_mw")


def first_short_year(plan: DataFrame) -> DataFrame:
    return plan.groupBy("region").agg(F.min(F.when(F.col("gap_mw") > 0, F.col("year"))).alias("first_year"), F.max_by("gap_mw", "year").alias("final_gap_mw"))


def _bound(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def budget_scenarios(budgets: DataFrame, keys: list[str]) -> DataFrame:
    """Five mixes per budget with capacity, energy, return, payback, scores and one recommendation.

    ``budgets`` has ``budget`` and ``baseline_met``. The mixes are inline, five rows per budget.
    """
    mix = F.explode(F.array(*[
        F.struct(F.lit(k).alias("key"), F.lit(n).alias("name"), F.lit(s).alias("s"), F.lit(w).alias("w"), F.lit(b).alias("b")) for k, n, s, w, b in MIXES
    ]))
    out = budgets.select(*keys, "budget", "baseline_met", mix.alias("_m")).select(*keys, "budget", "baseline_met", "_m.*")
    b = F.col("budget")
    out = out.withColumns({
        "solar_mw": F.round(b * F.col("s") / SOLAR_COST, 1), "wind_mw": F.round(b * F.col("w") / WIND_COST, 1),
        "storage_mwh": F.round(b * F.col("b") / STORAGE_COST, 0),
        "variety": F.when(F.col("s") > 0, 1).otherwise(0) + F.when(F.col("w") > 0, 1).otherwise(0) - 1,
    })
    energy = (F.col("solar_mw") * SOLAR_YIELD + F.col("wind_mw") * WIND_YIELD) * HOURS_PER_YEAR / 1000.0
    out = out.withColumn("annual_gwh", F.round(energy, 1))
    out = out.withColumn("net", F.greatest(F.lit(0.1), F.col("annual_gwh") * REVENUE_PER_GWH - b * RUNNING_COST_SHARE))
    base = _bound(F.col("baseline_met"), 28.0, 92.0)
    out = out.withColumns({
        "roi_pct": _bound(F.round(F.col("net") / b * 100.0, 1), 1.0, 30.0), "payback_years": _bound(F.round(b / F.col("net"), 1), 3.0, 40.0),
        "demand_met_pct": _bound(F.round(base + F.col("b") * 80.0 + F.col("variety") * 5.0, 0), 28.0, 96.0),
        "risk_score": _bound(0.62 - F.col("b") * 0.9 - F.col("variety") * 0.14, 0.08, 0.7),
    })
    risk = F.when(F.col("risk_score") < 0.3, "Lower").when(F.col("risk_score") < 0.5, "Moderate").otherwise("Higher")
    score = F.col("demand_met_pct") / 100.0 * 0.4 + F.col("roi_pct") / 30.0 * 0.4 + (1.0 - F.col("risk_score")) * 0.2
    ranked = Window.partitionBy(*keys).orderBy(F.round("score", 9).desc(), "key")
    return (
        out.withColumns({"risk": risk, "score": score})
        .withColumn("recommended", F.row_number().over(ranked) == 1)
        .withColumns({"solar_cost": F.round(b * F.col("s"), 0), "wind_cost": F.round(b * F.col("w"), 0), "storage_cost": F.round(b * F.col("b"), 0)})
        .drop("s", "w", "b", "net", "variety", "baseline_met")
    )


def demand_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """Peak hour and size (earliest of equals), mean, and margin of ``headroom_mw`` over the peak."""
    early = -F.unix_seconds("valid_time")
    out = points.groupBy(*keys).agg(
        F.max("p50_mw").alias("peak_mw"), F.max_by("valid_time", F.struct(F.round("p50_mw", 6), early)).alias("peak_at"),
        F.avg("p50_mw").alias("mean_mw"), F.max("headroom_mw").alias("headroom_mw"),
    )
    return out.withColumn("peak_margin_mw", F.col("headroom_mw") - F.col("peak_mw"))


def policy_summary(costs: DataFrame) -> DataFrame:
    """Per region over windows: mean costs, totals of both gains, their yearly scale, and counts.

    Value of the stochastic solution is expected-value cost minus stochastic cost; value of perfect
    information is stochastic cost minus wait-and-see cost.
    """
    vss = F.col("expected_value_cost") - F.col("stochastic_cost")
    evpi = F.col("stochastic_cost") - F.col("wait_and_see_cost")
    yearly = HOURS_PER_YEAR / F.sum("horizon_h")
    return costs.groupBy("region").agg(
        F.count("*").alias("windows"), F.sum("horizon_h").alias("hours"), F.avg("wait_and_see_cost").alias("wait_and_see"),
        F.avg("stochastic_cost").alias("stochastic"), F.avg("expected_value_cost").alias("expected_value"),
        F.sum(vss).alias("vss_total"), F.sum(evpi).alias("evpi_total"), (F.sum(vss) * yearly).alias("vss_per_year"),
        (F.sum(evpi) * yearly).alias("evpi_per_year"), F.count_if(vss > 1.0).alias("positive_vss"),
        F.count_if(F.col("committed_action") != F.col("deterministic_action")).alias("decision_differed"),
    )
