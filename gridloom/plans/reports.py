"""Audit of outputs as one table of checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.bands import action_label
from gridloom.operators import balance, contracts, fitting, metrics, scenarios
from gridloom.plans import balance as balance_plan

EPS = 1e-6


def audit_bands(points: DataFrame) -> list:
    return [
        ("band_ordered", points, (F.col("p10_mw") <= F.col("p50_mw") + 1e-9) & (F.col("p50_mw") <= F.col("p90_mw") + 1e-9)),
        ("band_within_capacity", points, (F.col("p10_mw") >= -1e-9) & (F.col("p90_mw") <= F.col("capacity_mw") + EPS)),
    ]


def audit_band_groups(points: DataFrame) -> list:
    """Group-level checks: coverage near nominal, small bias, width rising with lead, width varying."""
    regions = points.groupBy("region").agg(*metrics.metric_columns("actual_mw", "p50_mw", "capacity_mw"), *metrics.band_columns())
    widths = fitting.widths_rise(points, ["tech"])
    spread = points.groupBy("site_id").agg(F.stddev_pop(F.col("p90_mw") - F.col("p10_mw")).alias("s"))
    return [
        ("coverage_in_tolerance", regions, F.col("coverage").between(0.72, 0.92)),
        ("bias_under_four_percent", regions, F.abs("bias_pct") < 4.0),
        ("width_rises_with_lead", widths, F.col("rises")),
        ("width_varies", spread, F.col("s") > 0),
    ]


def audit_members(members: DataFrame, installed: DataFrame) -> list:
    capped = members.join(installed, "region")
    distinct = members.groupBy("region", "scenario").agg(F.sum(F.round("renewable_mw", 3)).alias("t")).groupBy("region").agg(
        (F.count_distinct("t") / F.count("*")).alias("share")
    )
    spread = members.groupBy("region", "offset").agg(F.stddev_pop("renewable_mw").alias("s")).groupBy("region").agg(F.avg("s").alias("s"))
    return [
        ("scenarios_nonnegative", capped, F.col("renewable_mw") >= -1e-9),
        ("scenarios_under_capacity", capped, F.col("renewable_mw") <= F.col("installed_mw") + EPS),
        ("scenarios_distinct", distinct, F.col("share") > 0.5),
        ("scenarios_spread", spread, F.col("s") > 0),
    ]


def audit_balance(points: DataFrame) -> list:
    p, q = F.col("p_surplus"), F.col("p_shortage")
    return [
        ("probabilities_in_range", points, p.between(0, 1) & q.between(0, 1)),
        ("residual_quantiles_ordered", points, (F.col("residual_p10_mw") <= F.col("residual_p50_mw") + EPS) & (F.col("residual_p50_mw") <= F.col("residual_p90_mw") + EPS)),
        ("renewable_quantiles_ordered", points, (F.col("renewable_p10_mw") <= F.col("renewable_p50_mw") + EPS) & (F.col("renewable_p50_mw") <= F.col("renewable_p90_mw") + EPS)),
        ("expected_nonnegative", points, (F.col("expected_surplus_mw") >= -1e-9) & (F.col("expected_shortage_mw") >= -1e-9)),
        ("not_both_likely", points, ~((p > 0.5) & (q > 0.5))),
        ("action_follows_thresholds", points, F.col("recommended_action") == action_label(p, q)),
        ("impossible_means_zero", points, (p > 0) | (F.abs("expected_surplus_mw") < EPS)),
        ("expected_is_p_times_conditional", points, F.abs(F.col("expected_shortage_mw") - q * F.col("conditional_shortage_mw")) < EPS),
    ]


def output_audit(t, *, hours: int = 72, n_scenarios: int = 200, seed: int = 7) -> DataFrame:
    """Bands, scenarios and balance of one data folder, checked rule by rule."""
    store = t.stored("residuals")
    members = balance_plan.window_members(
        scenarios.latest_window(store, hours), store, t.stored("demand"), fitting.dispatchable_headroom(t.market), hours=hours, n_scenarios=n_scenarios, seed=seed
    )
    installed = store.select("region", "site_id", "capacity_mw").distinct().groupBy("region").agg(F.sum("capacity_mw").alias("installed_mw"))
    return contracts.audit([
        *audit_bands(t.eval), *audit_band_groups(t.eval), *audit_members(members, installed), *audit_balance(balance.balance_points(members)),
    ])
