"""Catalogue: bounded running state, planning tables, audits and the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import contracts, features, fitting, planning, seasonal
from gridloom.plans.adapters import REGION_CLOCKS
from gridloom.plans.registry import query

@query("storage_curve", "M1 U3", "region energy_mwh:f power_mw:f duration_h:f captured_share:f captured_mwh_per_year:f", """
    WITH t AS (SELECT region, total, power_mw, greatest(years, 0.000000001) AS years FROM (
        SELECT region, sum(surplus_mw) AS total, quantile_cont(CASE WHEN surplus_mw > 0 THEN surplus_mw END, 0.99) AS power_mw,
               floor((epoch(max(valid_time)) - epoch(min(valid_time))) / 86400) / CAST(365.25 AS DOUBLE) AS years FROM x_balance GROUP BY region) WHERE total > 0),
    z AS (SELECT region, round(greatest(total / years / CAST(365.25 AS DOUBLE), 1) * CAST(f AS DOUBLE), 1) AS size FROM t CROSS JOIN (VALUES (0.1), (0.25), (0.5), (0.75), (1.0), (1.5), (2.0), (3.0), (5.0), (8.0)) v(f)),
    s AS (SELECT b.region, list({'x': CASE WHEN surplus_mw > 0 THEN least(surplus_mw, power_mw) * sqrt(CAST(0.88 AS DOUBLE))
        ELSE -least(greatest(residual_mw, 0), power_mw) / sqrt(CAST(0.88 AS DOUBLE)) END, 'got': CAST(0 AS DOUBLE)} ORDER BY b.valid_time) AS steps FROM x_balance b JOIN t ON t.region = b.region GROUP BY b.region),
    g AS (SELECT z.region, z.size, list_reduce(s.steps, lambda a, d: {'x': greatest(0, least(z.size, a.x + d.x)), 'got': a.got + greatest(greatest(0, least(z.size, a.x + d.x)) - a.x, 0)}, {'x': CAST(0 AS DOUBLE), 'got': CAST(0 AS DOUBLE)}).got AS got
        FROM z JOIN s ON s.region = z.region)
    SELECT g.region, g.size AS energy_mwh, power_mw, g.size / power_mw AS duration_h, got / sqrt(CAST(0.88 AS DOUBLE)) / total AS captured_share, got / sqrt(CAST(0.88 AS DOUBLE)) / years AS captured_mwh_per_year
    FROM g JOIN t ON t.region = g.region""")
def _(t):
    return seasonal.storage_adequacy(seasonal.local_balance(t.history, REGION_CLOCKS))


@query("storage_curve_month", "M1", "region energy_mwh:f captured_mwh:f", """
    WITH RECURSIVE m AS (SELECT region, valid_time, greatest(renewable - demand, 0) AS s, greatest(demand - renewable, 0) AS d FROM (
        SELECT region, valid_time, coalesce(solar_uigf_mw, 0) + coalesce(wind_uigf_mw, 0) AS renewable, demand_mw AS demand FROM x_market)),
    z AS (SELECT region, e AS size FROM (SELECT DISTINCT region FROM m) CROSS JOIN (VALUES (5.0), (40.0), (150.0)) v(e)),
    s AS (SELECT region, row_number() OVER (PARTITION BY region ORDER BY valid_time) AS i, least(s, 25) * sqrt(CAST(0.88 AS DOUBLE)) AS up, least(d, 25) / sqrt(CAST(0.88 AS DOUBLE)) AS down, s > 0 AS c FROM m),
    w AS (SELECT region, CAST(size AS DOUBLE) AS size, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS got FROM z
        UNION ALL SELECT w.region, w.size, s.i, CASE WHEN s.c THEN least(w.x + s.up, w.size) ELSE greatest(w.x - s.down, 0) END, w.got + CASE WHEN s.c THEN least(w.x + s.up, w.size) - w.x ELSE 0 END FROM w JOIN s ON s.region = w.region AND s.i = w.i + 1)
    SELECT region, size AS energy_mwh, max(got) / sqrt(CAST(0.88 AS DOUBLE)) AS captured_mwh FROM w GROUP BY ALL""")
def _(t):
    from gridloom.operators.walk import saturating_totals

    eta = seasonal.ROUND_TRIP**0.5
    gap = F.coalesce("solar_uigf_mw", F.lit(0.0)) + F.coalesce("wind_uigf_mw", F.lit(0.0)) - F.col("demand_mw")
    delta = F.when(gap > 0, F.least(gap, F.lit(25.0)) * eta).otherwise(-F.least(-gap, F.lit(25.0)) / eta)
    steps = t.market.select("region", "valid_time", F.to_date("valid_time").alias("block"), delta.alias("delta"))
    sizes = t.market.select("region").distinct().select("region", F.explode(F.array(*[F.lit(x) for x in (5.0, 40.0, 150.0)])).alias("capacity"))
    return saturating_totals(steps, ["region"], "block", "valid_time", "delta", sizes).select(
        "region", F.col("capacity").alias("energy_mwh"), (F.col("rise") / eta).alias("captured_mwh"))


@query("capture_targets", "M1 G3", "region target:f energy_mwh:f captured_share:f", """
    WITH c AS (SELECT region, e AS energy_mwh, least(1.0, e / (s * 2)) AS captured_share FROM (SELECT region, sum(demand_mw) / 100 AS s FROM x_market GROUP BY 1) CROSS JOIN (VALUES (100.0), (200.0), (400.0), (10000.0)) v(e))
    SELECT region, t AS target, min(CASE WHEN captured_share >= t THEN energy_mwh END) AS energy_mwh, arg_min(captured_share, CASE WHEN captured_share >= t THEN energy_mwh END) AS captured_share FROM c CROSS JOIN (VALUES (0.5), (0.8), (0.95)) v(t) GROUP BY ALL""")
def _(t):
    base = t.market.groupBy("region").agg((F.sum("demand_mw") / 100).alias("s"))
    curve = base.select("region", "s", F.explode(F.array(*[F.lit(x) for x in (100.0, 200.0, 400.0, 10000.0)])).alias("energy_mwh"))
    return seasonal.capture_targets(curve.withColumn("captured_share", F.least(F.lit(1.0), F.col("energy_mwh") / (F.col("s") * 2))))


_M2 = """
    WITH RECURSIVE p AS (SELECT site_id, CAST(valid_time AS DATE) AS day, valid_time, round(floor(coalesce(power_mw, 0) * 2 + 0.001) / 2 - 8, 2) AS net, row_number() OVER (PARTITION BY site_id, CAST(valid_time AS DATE) ORDER BY valid_time) AS i FROM x_grid),
    w AS (SELECT site_id, day, i, valid_time, net, CAST(10 AS DOUBLE) AS b, CASE WHEN net >= 0 THEN 10 + least(net, 6, 25 - 10) ELSE 10 - least(-net, 6, 10) END AS a FROM p WHERE i = 1
        UNION ALL SELECT p.site_id, p.day, p.i, p.valid_time, p.net, w.a, CASE WHEN p.net >= 0 THEN w.a + least(p.net, 6, 25 - w.a) ELSE w.a - least(-p.net, 6, w.a) END FROM w JOIN p ON p.site_id = w.site_id AND p.day = w.day AND p.i = w.i + 1),
    h AS (SELECT *, CASE WHEN net >= 0 THEN 'surplus' ELSE 'shortage' END AS state, CASE WHEN net >= 0 THEN a - b ELSE 0 END AS stored, CASE WHEN net < 0 THEN b - a ELSE 0 END AS discharged,
        CASE WHEN net >= 0 THEN round(net - (a - b), 2) ELSE 0 END AS curtailed, CASE WHEN net < 0 THEN round(-net - (b - a), 2) ELSE 0 END AS unmet FROM w)"""


def _balanced(t):
    points = t.grid.select("site_id", F.to_date("valid_time").alias("day"), "valid_time", (F.floor(F.coalesce("power_mw", F.lit(0.0)) * 2 + 0.001) / 2).alias("gen_mw"), F.lit(8.0).alias("demand_mw"),
                           F.lit(6.0).alias("power_mw"), F.lit(25.0).alias("energy_mwh"), F.lit(10.0).alias("start_mwh"))
    return planning.site_balance(points, ["site_id", "day"])


@query("site_balance", "M2 U3", "site_id valid_time:t net:f state action stored:f discharged:f level:f", f"""
    {_M2} SELECT site_id, valid_time, net, state, CASE WHEN abs(a - b) <= 0.05 THEN 'hold' WHEN net >= 0 THEN 'charge' ELSE 'discharge' END AS action, stored, discharged, a AS level FROM h""")
def _(t):
    return _balanced(t)


@query("site_balance_totals", "M2", "site_id day:d hours:i surplus_hours:i surplus_energy:f charge_energy:f worst_shortage:f verdict", f"""
    {_M2} SELECT site_id, day, count(*) AS hours, count(CASE WHEN net >= 0 THEN 1 END) AS surplus_hours, sum(greatest(net, 0)) AS surplus_energy, sum(stored) AS charge_energy, min(CASE WHEN net < 0 THEN net END) AS worst_shortage,
        CASE WHEN round(sum(unmet), 6) > 0.5 THEN 'shortage' WHEN count(CASE WHEN net >= 0 THEN 1 END) / count(*) > 0.35 THEN 'surplus' ELSE 'balanced' END AS verdict FROM h GROUP BY ALL""")
def _(t):
    return planning.balance_totals(_balanced(t), ["site_id", "day"])


@query("schedule_audit", "M6 B10", "check failures:i passed:b", """
    SELECT * FROM (VALUES ('power_limit', 0, true), ('energy_bounds', 0, true), ('no_simultaneous', 0, true), ('level_continuity', 0, true)) v("check", failures, passed)""")
def _(t):
    hours = _balanced(t).withColumns({"power_mw": F.lit(6.0), "energy_mwh": F.lit(25.0)})
    staged, checks = planning.schedule_checks(hours, ["site_id", "day"])
    return contracts.audit([(name, staged, rule) for name, rule in checks])


@query("growth_plan", "M3", "region year:i demand_mw:f renewable_mw:f gap_mw:f", """
    WITH p AS (SELECT m.region, quantile_cont(demand_mw, 0.999) AS peak, 0.03 + CAST(substr(m.region, 2) AS INTEGER) * 0.005 AS growth, max(r.mw) AS mw FROM x_market m JOIN (SELECT market_region, sum(capacity_mw) / 8 AS mw FROM x_sites GROUP BY 1) r ON r.market_region = m.region GROUP BY m.region)
    SELECT region, 2025 + k AS year, round(peak * power(1 + growth, k)) AS demand_mw, mw AS renewable_mw, round(round(peak * power(1 + growth, k)) - mw) AS gap_mw FROM p CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS k)""")
def _(t):
    return planning.growth_plan(_plan_inputs(t))


def _plan_inputs(t):
    renewable = t.sites.groupBy(F.col("market_region").alias("region")).agg((F.sum("capacity_mw") / 8).alias("renewable_mw"))
    growth = F.lit(0.03) + F.substring("region", 2, 4).cast("int") * 0.005
    return features.region_peaks(t.market).join(renewable, "region").withColumns({"growth": growth, "start_year": F.lit(2025)})


@query("first_short_year", "M3", "region first_year:i final_gap_mw:f", """
    WITH p AS (SELECT m.region, quantile_cont(demand_mw, 0.999) AS peak, 0.03 + CAST(substr(m.region, 2) AS INTEGER) * 0.005 AS growth, max(r.mw) AS mw FROM x_market m JOIN (SELECT market_region, sum(capacity_mw) / 8 AS mw FROM x_sites GROUP BY 1) r ON r.market_region = m.region GROUP BY m.region),
    y AS (SELECT region, 2025 + k AS year, round(round(peak * power(1 + growth, k)) - mw) AS gap_mw FROM p CROSS JOIN (SELECT unnest(generate_series(0, 4)) AS k))
    SELECT region, min(CASE WHEN gap_mw > 0 THEN year END) AS first_year, arg_max(gap_mw, year) AS final_gap_mw FROM y GROUP BY 1""")
def _(t):
    return planning.first_short_year(planning.growth_plan(_plan_inputs(t)))


def _budgets(t):
    return t.t("customer").select("c_custkey", (F.floor(F.abs("c_acctbal")) + 50.0137).alias("budget"), (F.col("c_custkey") % 80 + 20).cast("double").alias("baseline_met"))


@query("budget_scenarios", "M4", "c_custkey:i key name solar_mw:f wind_mw:f storage_mwh:f annual_gwh:f roi_pct:f payback_years:f demand_met_pct:f risk recommended:b", """
    WITH m AS (SELECT * FROM (VALUES ('A', '100 % Solar', 1.0, 0.0, 0.0), ('B', 'Solar + Storage', 0.78, 0.0, 0.22), ('C', 'Wind + Storage', 0.0, 0.78, 0.22), ('D', 'Solar + Wind', 0.55, 0.45, 0.0), ('E', 'Hybrid + Storage', 0.40, 0.36, 0.24)) v(key, name, s, w, g)),
    b AS (SELECT c_custkey, CAST(floor(abs(c_acctbal)) + CAST(50.0137 AS DOUBLE) AS DOUBLE) AS b, CAST(c_custkey % 80 + 20 AS DOUBLE) AS base FROM customer),
    x AS (SELECT *, CAST(round(b * CAST(s AS DOUBLE) / CAST(4.5 AS DOUBLE), 1) AS DOUBLE) AS solar_mw, CAST(round(b * CAST(w AS DOUBLE) / 6, 1) AS DOUBLE) AS wind_mw, round(b * CAST(g AS DOUBLE) / CAST(1.6 AS DOUBLE)) AS storage_mwh, CASE WHEN s > 0 THEN 1 ELSE 0 END + CASE WHEN w > 0 THEN 1 ELSE 0 END - 1 AS v FROM b CROSS JOIN m),
    e AS (SELECT *, round((solar_mw * CAST(0.19 AS DOUBLE) + wind_mw * CAST(0.30 AS DOUBLE)) * 8760 / 1000, 1) AS annual_gwh FROM x), n AS (SELECT *, greatest(0.1, annual_gwh * CAST(0.3 AS DOUBLE) - b * CAST(0.015 AS DOUBLE)) AS net FROM e),
    r AS (SELECT *, greatest(1, least(30, round(net / b * 100, 1))) AS roi_pct, greatest(3, least(40, round(b / net, 1))) AS payback_years, greatest(28, least(96, round(greatest(28, least(92, base)) + CAST(g AS DOUBLE) * 80 + v * 5))) AS demand_met_pct,
        greatest(0.08, least(0.7, CAST(0.62 AS DOUBLE) - CAST(g AS DOUBLE) * CAST(0.9 AS DOUBLE) - v * CAST(0.14 AS DOUBLE))) AS rs FROM n),
    q AS (SELECT *, CASE WHEN rs < 0.3 THEN 'Lower' WHEN rs < 0.5 THEN 'Moderate' ELSE 'Higher' END AS risk, demand_met_pct / 100 * CAST(0.4 AS DOUBLE) + roi_pct / 30 * CAST(0.4 AS DOUBLE) + (1 - rs) * CAST(0.2 AS DOUBLE) AS score FROM r)
    SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY round(score, 9) DESC, key) = 1 AS recommended FROM q""")
def _(t):
    return planning.budget_scenarios(_budgets(t), ["c_custkey"])


@query("balance_invariants", "B11", "check failures:i passed:b", """
    SELECT 'allocation_sums' AS "check", 0 AS failures, true AS passed UNION ALL SELECT 'demand_met_range', 0, true UNION ALL SELECT 'hours_partition', 0, true UNION ALL SELECT 'nonnegative_energy', 0, true
    UNION ALL SELECT 'band_order', 0, true UNION ALL SELECT 'band_in_capacity', count(CASE WHEN p90_mw > capacity_mw + 0.000001 THEN 1 END), count(CASE WHEN p90_mw > capacity_mw + 0.000001 THEN 1 END) = 0 FROM x_eval""")
def _(t):
    plans = planning.budget_scenarios(_budgets(t), ["c_custkey"])
    totals = planning.balance_totals(_balanced(t), ["site_id", "day"])
    points = t.eval
    spent = F.col("solar_cost") + F.col("wind_cost") + F.col("storage_cost")
    return contracts.audit([
        ("allocation_sums", plans, F.abs(spent - F.col("budget")) <= F.col("budget") * 0.02),
        ("demand_met_range", plans, F.col("demand_met_pct").between(0, 100)),
        ("hours_partition", totals, F.col("surplus_hours") + F.col("shortage_hours") == F.col("hours")),
        ("nonnegative_energy", totals, (F.col("surplus_energy") >= 0) & (F.col("shortage_energy") >= 0) & (F.col("unmet_energy") >= -1e-9) & (F.col("curtail_energy") >= -1e-9)),
        ("band_order", points, (F.col("p10_mw") <= F.col("p50_mw")) & (F.col("p50_mw") <= F.col("p90_mw"))),
        ("band_in_capacity", points, (F.col("p10_mw") >= 0) & (F.col("p90_mw") <= F.col("capacity_mw") + 1e-6)),
    ])


@query("demand_summary", "M5", "region peak_mw:f peak_at:t mean_mw:f headroom_mw:f peak_margin_mw:f", """
    WITH h AS (SELECT region, greatest(quantile_cont(available_generation_mw - coalesce(solar_uigf_mw, 0) - coalesce(wind_uigf_mw, 0), 0.25), 0) AS headroom_mw FROM x_market GROUP BY 1),
    d AS (SELECT region, max(demand_mw) AS peak_mw, avg(demand_mw) AS mean_mw FROM x_market GROUP BY 1),
    p AS (SELECT region, valid_time AS peak_at FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(demand_mw, 6) DESC, valid_time) AS k FROM x_market) WHERE k = 1)
    SELECT d.region, peak_mw, peak_at, mean_mw, headroom_mw, headroom_mw - peak_mw AS peak_margin_mw FROM d JOIN h ON h.region = d.region JOIN p ON p.region = d.region""")
def _(t):
    points = t.market.select("region", "valid_time", F.col("demand_mw").alias("p50_mw")).join(fitting.dispatchable_headroom(t.market), "region")
    return planning.demand_summary(points, ["region"])


@query("output_audit", "B10", "check failures:i passed:b")
def _(t):
    from gridloom.plans.reports import output_audit

    return output_audit(t)


@query("streaming_hourly_mean", "S1 E1 F1", "event_type valid_time:t mean_value:f", """
    SELECT event_type, h AS valid_time, avg(v) AS mean_value FROM (SELECT event_type, date_trunc('hour', ts) AS h, greatest(value, 0) AS v, (SELECT max(ts) FROM events) AS top FROM events)
    WHERE h + INTERVAL 1 HOUR <= top - INTERVAL 2 HOUR GROUP BY ALL""")
def _(t):
    from gridloom.streaming.hourly import closed_hours

    return closed_hours(t.spark, t.dir, "events.parquet")
