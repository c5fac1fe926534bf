"""Catalogue: windows, scenario ensembles, regional balance and its verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import balance, calibration, fitting, scenarios, splits
from gridloom.plans import balance as balance_plan
from gridloom.plans.registry import query
from gridloom.sources.tables import first_scenarios

HOURS, MEMBERS, SEED = 72, 200, 7
# Windows scored for scenarios and for the balance.
WINDOWS, BALANCE_WINDOWS = 40, 30

_STARTS = """
    st AS (SELECT DISTINCT region, valid_time FROM x_residuals),
    ws AS (SELECT region, valid_time AS b0 FROM (SELECT *, lead(valid_time, 71) OVER (PARTITION BY region ORDER BY valid_time) AS e FROM st) WHERE e = valid_time + INTERVAL 71 HOUR),
    cs AS (SELECT region, site_id, valid_time AS b0 FROM (SELECT *, lead(valid_time, 71) OVER (PARTITION BY site_id ORDER BY valid_time) AS e FROM x_residuals) WHERE e = valid_time + INTERVAL 71 HOUR),
    ns AS (SELECT region, count(DISTINCT site_id) AS n FROM x_residuals GROUP BY 1),
    bs AS (SELECT ws.region, ws.b0, count(*) AS c, max(ns.n) AS n FROM ws JOIN cs ON cs.region = ws.region AND cs.b0 = ws.b0 JOIN ns ON ns.region = ws.region GROUP BY ws.region, ws.b0 HAVING count(*) >= 0.8 * max(ns.n)),
    us AS (SELECT region, b0 AS w0 FROM bs WHERE c = n)"""
_LATEST = "win AS (SELECT region, max(w0) AS w0 FROM us GROUP BY 1)"
_SAMPLED = """win AS (SELECT region, w0 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY md5(strftime(w0, '%Y-%m-%d %H:%M:%S') || '#7')) AS k FROM us) WHERE k <= 40)"""
_SCORED = _SAMPLED.replace("k <= 40", "k <= 30")
_CHAIN = """
    pk AS (SELECT win.region, w0, b0, row_number() OVER (PARTITION BY win.region, w0 ORDER BY md5(strftime(b0, '%Y-%m-%d %H:%M:%S') || '#7')) - 1 AS r, count(*) OVER (PARTITION BY win.region, w0) AS n
        FROM win JOIN bs ON bs.region = win.region WHERE hour(b0) = hour(w0) AND abs(epoch(b0) - epoch(w0)) >= 259200),
    sc AS (SELECT region, w0, b0, s AS scenario FROM pk JOIN (SELECT unnest(generate_series(0, 199)) AS s) g ON g.s % pk.n = pk.r),
    fh AS (SELECT r.region, win.w0, r.site_id, r.tech, r.valid_time, r.p50_mw, r.capacity_mw, r.actual_mw, date_diff('hour', win.w0, r.valid_time) AS o
        FROM x_residuals r JOIN win ON win.region = r.region AND r.valid_time >= win.w0 AND r.valid_time < win.w0 + INTERVAL 72 HOUR),
    er AS (SELECT sc.region, sc.w0, sc.scenario, fh.o, fh.valid_time, fh.site_id, fh.p50_mw, fh.capacity_mw, fh.actual_mw, coalesce(e.residual, 0) AS residual
        FROM fh JOIN sc ON sc.region = fh.region AND sc.w0 = fh.w0 LEFT JOIN x_residuals e ON e.site_id = fh.site_id AND e.valid_time = sc.b0 + to_hours(CAST(fh.o AS INTEGER))),
    tot AS (SELECT region, w0, o, valid_time, scenario, sum(least(greatest(p50_mw + residual * capacity_mw, 0), capacity_mw)) AS renewable FROM er GROUP BY ALL),
    tru AS (SELECT region, w0, o, sum(actual_mw) AS actual FROM fh GROUP BY ALL)"""
_DEMAND = """
    dv AS (SELECT region, valid_time AS b0 FROM (SELECT *, lead(valid_time, 71) OVER (PARTITION BY region ORDER BY valid_time) AS e FROM x_demand) WHERE e = valid_time + INTERVAL 71 HOUR),
    dm AS (SELECT sc.*, dv.b0 IS NOT NULL AS ok FROM sc LEFT JOIN dv ON dv.region = sc.region AND dv.b0 = sc.b0),
    vr AS (SELECT region, w0, b0 AS spare, row_number() OVER (PARTITION BY region, w0 ORDER BY scenario) - 1 AS turn, count(*) OVER (PARTITION BY region, w0) AS n FROM dm WHERE ok),
    dc AS (SELECT dm.region, dm.w0, dm.scenario, CASE WHEN dm.ok THEN dm.b0 ELSE vr.spare END AS b0 FROM dm LEFT JOIN vr ON vr.region = dm.region AND vr.w0 = dm.w0 AND vr.turn = dm.scenario % vr.n),
    dd AS (SELECT dc.region, dc.w0, dc.scenario, date_diff('hour', dc.w0, d.valid_time) AS o, d.p50_mw + coalesce(e.residual, 0) * d.peak_mw AS demand
        FROM dc JOIN x_demand d ON d.region = dc.region AND d.valid_time >= dc.w0 AND d.valid_time < dc.w0 + INTERVAL 72 HOUR
        LEFT JOIN x_demand e ON e.region = dc.region AND e.valid_time = dc.b0 + (d.valid_time - dc.w0)),
    hd AS (SELECT region, greatest(quantile_cont(available_generation_mw - coalesce(solar_uigf_mw, 0) - coalesce(wind_uigf_mw, 0), 0.25), 0) / 3 AS headroom FROM x_market GROUP BY 1),
    mb AS (SELECT tot.*, dd.demand, dd.demand - tot.renewable AS residual, hd.headroom FROM tot JOIN dd ON dd.region = tot.region AND dd.w0 = tot.w0 AND dd.o = tot.o AND dd.scenario = tot.scenario JOIN hd ON hd.region = tot.region),
    bp AS (SELECT region, w0, o, valid_time, count(*) AS n_scenarios, quantile_cont(demand, 0.5) AS demand_p50_mw, quantile_cont(renewable, 0.1) AS renewable_p10_mw, quantile_cont(renewable, 0.9) AS renewable_p90_mw,
        quantile_cont(residual, 0.5) AS residual_p50_mw, avg(CAST(residual < 0 AS INTEGER)) AS p_surplus, avg(CAST(residual > headroom AS INTEGER)) AS p_shortage,
        coalesce(avg(CASE WHEN residual < 0 THEN -residual END), 0) AS conditional_surplus_mw, coalesce(avg(CASE WHEN residual > headroom THEN residual - headroom END), 0) AS conditional_shortage_mw FROM mb GROUP BY ALL)"""


def _latest(t):
    windows = scenarios.latest_window(t.stored("residuals"), HOURS)
    blocks = scenarios.window_blocks(windows, t.stored("residuals"), HOURS, MEMBERS, SEED)
    return windows, blocks, scenarios.window_hours(windows, t.stored("residuals"), HOURS)


def _headroom(t):
    return fitting.dispatchable_headroom(t.market).withColumn("headroom_mw", F.col("headroom_mw") / 3)


def _members(t):
    return balance_plan.window_members(scenarios.latest_window(t.stored("residuals"), HOURS), t.stored("residuals"), t.stored("demand"), _headroom(t), hours=HOURS, n_scenarios=MEMBERS, seed=SEED)


@query("latest_windows", "G5", "region window_start:t", f"WITH {_STARTS}, {_LATEST} SELECT region, w0 AS window_start FROM win")
def _(t):
    return scenarios.latest_window(t.stored("residuals"), HOURS)


@query("sampled_windows", "L12", "region window_start:t", f"WITH {_STARTS}, {_SAMPLED} SELECT region, w0 AS window_start FROM win")
def _(t):
    return scenarios.sampled_windows(t.stored("residuals"), HOURS, WINDOWS, SEED)


@query("scenario_picks", "L13", "region window_start:t scenario:i block_start:t", f"WITH {_STARTS}, {_LATEST}, {_CHAIN} SELECT region, w0 AS window_start, scenario, b0 AS block_start FROM sc")
def _(t):
    return _latest(t)[1]


@query("site_scenarios", "D13", "region scenario:i valid_time:t site_id mw:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN} SELECT region, scenario, valid_time, site_id, least(greatest(p50_mw + 1.3 * residual * capacity_mw, 0), capacity_mw) AS mw FROM er""")
def _(t):
    _, blocks, hours = _latest(t)
    return scenarios.site_scenarios(hours, blocks, t.stored("residuals"), HOURS, 1.3)


@query("regional_scenarios", "D13 E25", "region window_start:t offset:i scenario:i renewable_mw:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN} SELECT region, w0 AS window_start, o AS "offset", scenario, renewable AS renewable_mw FROM tot""")
def _(t):
    _, blocks, hours = _latest(t)
    return scenarios.regional_scenarios(hours, blocks, t.stored("residuals"), HOURS)


@query("first_scenarios", "A16", "region offset:i members:i mean_mw:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN} SELECT region, o AS "offset", count(*) AS members, avg(renewable) AS mean_mw FROM tot WHERE scenario < 8 GROUP BY ALL""")
def _(t):
    _, blocks, hours = _latest(t)
    members = first_scenarios(scenarios.regional_scenarios(hours, blocks, t.stored("residuals"), HOURS), 8)
    return members.groupBy("region", "offset").agg(F.count("*").alias("members"), F.avg("renewable_mw").alias("mean_mw"))


@query("ensemble_quantiles", "E25", "region offset:i mean_mw:f p10_mw:f p50_mw:f p90_mw:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN} SELECT region, o AS "offset", avg(renewable) AS mean_mw, quantile_cont(renewable, 0.1) AS p10_mw, quantile_cont(renewable, 0.5) AS p50_mw, quantile_cont(renewable, 0.9) AS p90_mw FROM tot GROUP BY ALL""")
def _(t):
    _, blocks, hours = _latest(t)
    return scenarios.ensemble_quantiles(scenarios.regional_scenarios(hours, blocks, t.stored("residuals"), HOURS), ["region", "offset"])


@query("naive_quantile_sum", "E26", "region valid_time:t p10_mw:f p50_mw:f p90_mw:f", """
    SELECT region, valid_time, sum(p10_mw) AS p10_mw, sum(p50_mw) AS p50_mw, sum(p90_mw) AS p90_mw FROM x_leads WHERE horizon_h = 24 GROUP BY ALL""")
def _(t):
    return scenarios.naive_quantile_sum(t.leads.where("horizon_h = 24"), ["region", "valid_time"])


@query("error_store", "E31", "region site_id valid_time:t residual:f", "SELECT region, site_id, valid_time, (actual_mw - p50_mw) / capacity_mw AS residual FROM x_eval WHERE horizon_h = 24")
def _(t):
    return scenarios.error_store(t.eval)


@query("rank_histogram", "E27", "bin:i n:i share:f flatness:f", f"""
    WITH {_STARTS}, {_SAMPLED}, {_CHAIN},
    h AS (SELECT CAST(least(floor(r * 10 / (n + 1)), 9) AS INTEGER) AS bin, count(*) AS n FROM (SELECT tot.region, tot.w0, tot.o, count(CASE WHEN renewable < actual THEN 1 END) AS r, count(*) AS n FROM tot JOIN tru ON tru.region = tot.region AND tru.w0 = tot.w0 AND tru.o = tot.o GROUP BY ALL) GROUP BY 1)
    SELECT bin, n, n / sum(n) OVER () AS share, stddev_pop(n) OVER () / sum(n) OVER () * 10 AS flatness FROM h""")
def _(t):
    windows = scenarios.sampled_windows(t.stored("residuals"), HOURS, WINDOWS, SEED)
    blocks = scenarios.window_blocks(windows, t.stored("residuals"), HOURS, MEMBERS, SEED)
    hours = scenarios.window_hours(windows, t.stored("residuals"), HOURS)
    ensemble = scenarios.regional_scenarios(hours, blocks, t.stored("residuals"), HOURS)
    return scenarios.rank_histogram(ensemble, scenarios.regional_truth(hours), balance.AT)


@query("dispersion_fit", "E33 D19", "dispersion:f coverage:f", f"""
    WITH {_STARTS}, {_SAMPLED}, {_CHAIN}, g AS (SELECT (8 + unnest(generate_series(0, 18))) / CAST(10 AS DOUBLE) AS d),
    q AS (SELECT region, w0, o, d, quantile_cont(x, 0.1) AS lo, quantile_cont(x, 0.9) AS hi FROM (SELECT region, w0, o, scenario, d, sum(least(greatest(p50_mw + d * residual * capacity_mw, 0), capacity_mw)) AS x FROM er CROSS JOIN g GROUP BY ALL) GROUP BY ALL),
    c AS (SELECT d, avg(c) AS c FROM (SELECT q.region, d, avg(CAST(actual + 0.0000001 >= lo AND actual - 0.0000001 <= hi AS INTEGER)) AS c FROM q JOIN tru ON tru.region = q.region AND tru.w0 = q.w0 AND tru.o = q.o GROUP BY ALL) GROUP BY 1)
    SELECT d AS dispersion, c AS coverage FROM c ORDER BY round(abs(c - 0.8), 9), d LIMIT 1""")
def _(t):
    windows = scenarios.sampled_windows(t.stored("residuals"), HOURS, WINDOWS, SEED)
    blocks = scenarios.window_blocks(windows, t.stored("residuals"), HOURS, MEMBERS, SEED)
    hours = scenarios.window_hours(windows, t.stored("residuals"), HOURS)
    ensemble = scenarios.regional_scenarios(hours, blocks, t.stored("residuals"), HOURS, factors=scenarios.DISPERSION_GRID)
    bands = scenarios.ensemble_quantiles(ensemble, [*balance.AT, "dispersion"])
    eps = 1e-7
    widened = bands.withColumns({"p10_mw": F.col("p10_mw") - eps, "p90_mw": F.col("p90_mw") + eps})
    return scenarios.fit_dispersion(scenarios.coverage_of(widened, scenarios.regional_truth(hours), balance.AT, ["region", "dispersion"]))


@query("scenario_verification", "E34", "region hours:i mean_width:f naive_width:f width_ratio:f", f"""
    WITH {_STARTS}, {_SAMPLED}, {_CHAIN},
    q AS (SELECT region, w0, o, quantile_cont(renewable, 0.9) - quantile_cont(renewable, 0.1) AS w FROM tot GROUP BY ALL),
    n AS (SELECT region, w0, o, sum(0.8 * p50_mw) AS w FROM fh GROUP BY ALL)
    SELECT q.region, count(*) AS hours, avg(q.w) AS mean_width, avg(n.w) AS naive_width, avg(n.w) / avg(q.w) AS width_ratio FROM q JOIN n ON n.region = q.region AND n.w0 = q.w0 AND n.o = q.o GROUP BY 1""")
def _(t):
    windows = scenarios.sampled_windows(t.stored("residuals"), HOURS, WINDOWS, SEED)
    blocks = scenarios.window_blocks(windows, t.stored("residuals"), HOURS, MEMBERS, SEED)
    banded = t.stored("residuals").withColumns({"p10_mw": F.col("p50_mw") * 0.6, "p90_mw": F.col("p50_mw") * 1.4})
    hours = scenarios.window_hours(windows, banded, HOURS)
    return scenarios.verify(hours, scenarios.regional_scenarios(hours, blocks, t.stored("residuals"), HOURS))


@query("site_scenario_coverage", "E34", "site_id coverage_before:f coverage_after:f")
def _(t):
    _, blocks, _ = _latest(t)
    banded = t.stored("residuals").withColumns({"p10_mw": F.col("p50_mw") * 0.6, "p90_mw": F.col("p50_mw") * 1.4})
    hours = scenarios.window_hours(scenarios.latest_window(t.stored("residuals"), HOURS), banded, HOURS)
    return scenarios.site_coverage(hours, scenarios.site_scenarios(hours, blocks, t.stored("residuals"), HOURS, packed=True))


@query("demand_scenarios", "D12", "region offset:i scenario:i demand_mw:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN}, {_DEMAND} SELECT region, o AS "offset", scenario, demand AS demand_mw FROM dd""")
def _(t):
    windows, blocks, _ = _latest(t)
    return balance.demand_scenarios(scenarios.window_hours(windows, t.stored("demand"), HOURS), blocks, t.stored("demand"), HOURS)


_POINTS = "region valid_time:t horizon_h:i n_scenarios:i demand_p50_mw:f renewable_p10_mw:f renewable_p90_mw:f residual_p50_mw:f p_surplus:f p_shortage:f conditional_surplus_mw:f conditional_shortage_mw:f expected_surplus_mw:f recommended_action"
_ACTION = "CASE WHEN p_shortage >= 0.5 THEN 'cover_shortage' WHEN p_shortage >= 0.2 THEN 'hold_reserve' WHEN p_surplus >= 0.5 THEN 'absorb_surplus' WHEN p_surplus >= 0.2 THEN 'prepare_to_absorb' ELSE 'normal' END"


@query("balance_points", "E28 L15 C32", _POINTS, f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN}, {_DEMAND} SELECT *, o + 1 AS horizon_h, p_surplus * conditional_surplus_mw AS expected_surplus_mw, {_ACTION} AS recommended_action FROM bp""")
def _(t):
    return balance.balance_points(_members(t))


@query("mapped_balance_points", "E28 C33", "region valid_time:t p_surplus:f p_shortage:f expected_shortage_mw:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN}, {_DEMAND}, k AS (SELECT *, CAST(least(floor(p_shortage * 20), 19) AS DOUBLE) AS i FROM bp),
    m AS (SELECT *, CASE WHEN region = 'R4' THEN p_shortage ELSE (i / 20) * (i / 20) + (((i + 1) / 20) * ((i + 1) / 20) - (i / 20) * (i / 20)) * (p_shortage * 20 - i) END AS q FROM k)
    SELECT region, valid_time, p_surplus, q AS p_shortage, q * conditional_shortage_mw AS expected_shortage_mw FROM m""")
def _(t):
    knots = F.array(*[F.lit((k / 20) ** 2) for k in range(21)])
    maps = t.market.where("region <> 'R4'").select("region").distinct().select("region", F.lit("shortage").alias("event"), knots.alias("knots"))
    return balance.balance_points(_members(t), maps)


@query("balance_payload", "L15 A14 F11", "region window_start:t n_points:i peak_shortage:f expected_mwh:f", f"""
    WITH {_STARTS}, {_LATEST}, {_CHAIN}, {_DEMAND} SELECT region, w0 AS window_start, count(*) AS n_points, max(p_shortage) AS peak_shortage, sum(p_shortage * conditional_shortage_mw) AS expected_mwh FROM bp GROUP BY ALL""")
def _(t):
    points = balance_plan.build(t.stored("residuals"), t.stored("demand"), _headroom(t), hours=HOURS, n_scenarios=MEMBERS, seed=SEED)
    docs = balance_plan.payload(points)
    return docs.select(
        "region", "window_start", F.size("points").alias("n_points"), F.array_max("points.p_shortage").alias("peak_shortage"),
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["expected_shortage_mw"]).alias("expected_mwh"),
    )


@query("balance_outcomes", "D17 E30", "region valid_time:t event outcome:f", f"""
    WITH {_STARTS}, {_SCORED}, hd AS (SELECT region, greatest(quantile_cont(available_generation_mw - coalesce(solar_uigf_mw, 0) - coalesce(wind_uigf_mw, 0), 0.25), 0) / 3 AS headroom FROM x_market GROUP BY 1),
    a AS (SELECT win.region, r.valid_time, win.w0, sum(r.actual_mw) AS ren FROM x_residuals r JOIN win ON win.region = r.region AND r.valid_time >= w0 AND r.valid_time < w0 + INTERVAL 72 HOUR GROUP BY ALL),
    z AS (SELECT a.region, a.valid_time, d.actual_mw - a.ren AS res, hd.headroom FROM a JOIN x_demand d ON d.region = a.region AND d.valid_time = a.valid_time JOIN hd ON hd.region = a.region)
    SELECT region, valid_time, 'surplus' AS event, CAST(res < 0 AS INTEGER) AS outcome FROM z UNION ALL SELECT region, valid_time, 'shortage', CAST(res > headroom AS INTEGER) FROM z""")
def _(t):
    return balance_plan.scored_windows(t.stored("residuals"), t.stored("demand"), _headroom(t), hours=HOURS, n_windows=BALANCE_WINDOWS, n_scenarios=MEMBERS, seed=SEED)


@query("balance_verification", "L16 E29 E30", "region event calibrated:b n:i base_rate:f brier:f brier_climatology:f skill:f")
def _(t):
    scored = balance_plan.scored_windows(t.stored("residuals"), t.stored("demand"), _headroom(t), hours=HOURS, n_windows=BALANCE_WINDOWS, n_scenarios=MEMBERS, seed=SEED)
    return balance_plan.calibrate_and_verify(scored)[1]


@query("isotonic_map", "E29 F18", "half knot:i y:f", """
    WITH o AS (SELECT CASE WHEN event_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, user_id % 11 AS k, CAST(CAST(value AS INTEGER) % 10 < user_id % 11 OR value > 30 AS INTEGER) AS y FROM events),
    p AS (SELECT half, k, sum(y) AS s, count(*) AS n FROM o GROUP BY ALL),
    b AS (SELECT a.half, a.k AS lo, c.k AS hi, (SELECT sum(s) / sum(n) FROM p x WHERE x.half = a.half AND x.k BETWEEN a.k AND c.k) AS m FROM p a JOIN p c ON c.half = a.half AND c.k >= a.k),
    i AS (SELECT p.half, p.k, b.lo, min(b.m) AS m FROM p JOIN b ON b.half = p.half AND b.lo <= p.k AND b.hi >= p.k GROUP BY ALL), f AS (SELECT half, k, max(m) AS y FROM i GROUP BY ALL),
    g AS (SELECT h.half, j AS knot, CASE WHEN j = 0 THEN 0 WHEN j = 20 THEN 1 WHEN j % 2 = 0 THEN a.y ELSE (a.y + c.y) / 2 END AS y FROM (SELECT DISTINCT half FROM p) h CROSS JOIN (SELECT unnest(generate_series(0, 20)) AS j) v
        LEFT JOIN f a ON a.half = h.half AND a.k = j // 2 LEFT JOIN f c ON c.half = h.half AND c.k = j // 2 + 1)
    SELECT half, knot, max(y) OVER (PARTITION BY half ORDER BY knot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS y FROM g""")
def _(t):
    k = F.col("user_id") % 11
    happened = (F.bround("value").cast("int") % 10 < k) | (F.col("value") > 30)
    rows = t.events.select(F.when(F.col("event_id") % 2 == 0, "even").otherwise("odd").alias("half"), (k / 10.0).alias("p"), happened.cast("double").alias("o"))
    maps = calibration.fit_probability_maps(rows, ["half"], "p", "o")
    return maps.select("half", F.posexplode("knots").alias("knot", "y"))


@query("seeded_order", "L13 L12", "event_type rank:i user_id:i", """
    SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(user_id AS VARCHAR) || '#5')) AS rank, user_id FROM (SELECT DISTINCT event_type, user_id FROM events)
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(user_id AS VARCHAR) || '#5')) <= 6""")
def _(t):
    from gridloom.operators.joins import rank_within

    users = t.events.select("event_type", "user_id").distinct()
    return rank_within(users, ["event_type"], [splits.seeded(F.col("user_id"), 5)], 6)
