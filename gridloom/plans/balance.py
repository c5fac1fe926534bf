"""Regional balance for all regions in one plan: windows, scenarios, balance, events, payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators import balance, calibration, metrics, scenarios
from gridloom.session import materialise
from gridloom.sources.payloads import nest

FIT_SHARE = 0.60


def window_members(
    windows: DataFrame, store: DataFrame, demand: DataFrame, headroom: DataFrame, *, hours: int, n_scenarios: int, seed: int, dispersion: float = 1.0
) -> DataFrame:
    """Joint demand and renewable scenarios of the given windows, as a balance per scenario hour.

    ``store`` is the long error store with ``p50_mw, actual_mw, capacity_mw``; ``demand`` likewise
    per region with ``peak_mw``.
    """
    blocks = scenarios.window_blocks(windows, store, hours, n_scenarios, seed)
    site_hours = scenarios.window_hours(windows, store, hours)
    renewable = scenarios.regional_scenarios(site_hours, blocks, store, hours, dispersion=dispersion)
    demand_hours = scenarios.window_hours(windows, demand, hours)
    load = balance.demand_scenarios(demand_hours, blocks, demand, hours)
    return balance.scenario_balance(load, renewable, headroom)


def build(store: DataFrame, demand: DataFrame, headroom: DataFrame, *, hours: int = 72, n_scenarios: int = 200, seed: int = 3, maps: DataFrame | None = None) -> DataFrame:
    """Balance points of each region's latest complete window."""
    windows = scenarios.latest_window(store, hours)
    members = window_members(windows, store, demand, headroom, hours=hours, n_scenarios=n_scenarios, seed=seed)
    return balance.balance_points(members, maps)


def payload(points: DataFrame) -> DataFrame:
    """One nested document per region and window: points and events. A window is at most 72 hours."""
    fields = [c for c in points.columns if c not in ("region", "window_start", "valid_time")]
    body = nest(points, ["region", "window_start"], "valid_time", fields)
    events = nest(balance.all_event_runs(points), ["region", "window_start"], "from_utc", ["kind", "to_utc", "hours", "peak_probability", "energy_mwh"], "events")
    return body.join(events, ["region", "window_start"], "left")


def scored_windows(
    store: DataFrame, demand: DataFrame, headroom: DataFrame, *, hours: int, n_windows: int, n_scenarios: int, seed: int, maps: DataFrame | None = None
) -> DataFrame:
    """Event probabilities and outcomes over sampled windows: ``(region, valid_time, event, p, outcome)``."""
    windows = scenarios.sampled_windows(store, hours, n_windows, seed)
    members = window_members(windows, store, demand, headroom, hours=hours, n_scenarios=n_scenarios, seed=seed)
    points = balance.balance_points(members, maps)
    truth = scenarios.regional_truth(scenarios.window_hours(windows, store, hours))
    return balance.event_scores(balance.outcomes(points, truth, demand, headroom))


def fit_side(scored: DataFrame, share: float = FIT_SHARE) -> DataFrame:
    """Flag the earlier ``share`` of each region's scored hours: column ``fits``."""
    hours = scored.select("region", "valid_time").distinct()
    w = Window.partitionBy("region")
    ranked = hours.select(
        "region", "valid_time", (F.row_number().over(w.orderBy("valid_time")) <= F.floor(F.count("*").over(w) * share)).alias("fits")
    )
    return scored.join(ranked, ["region", "valid_time"])


def calibrate_and_verify(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fit the probability maps on the earlier hours and score raw and mapped on the later ones."""
    from gridloom.functions.bands import map_probability

    sided = materialise(fit_side(scored))
    maps = calibration.fit_probability_maps(sided.where("fits"), ["region", "event"], "p", "outcome")
    later = sided.where(~F.col("fits")).join(maps, ["region", "event"], "left").withColumn("q", map_probability(F.col("p"), F.col("knots")))
    raw = metrics.brier(later, ["region", "event"], "p", "outcome").withColumn("calibrated", F.lit(False))
    mapped = metrics.brier(later, ["region", "event"], "q", "outcome").withColumn("calibrated", F.lit(True))
    return maps, raw.unionByName(mapped)
