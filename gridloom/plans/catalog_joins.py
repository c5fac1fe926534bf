"""Catalogue: joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import features, fitting, joins, metrics
from gridloom.operators.resample import keep_one
from gridloom.plans.adapters import REGION_CLOCKS
from gridloom.plans.registry import query
from gridloom.sources import market, stations


@query("demand_price_rooftop", "D1", "region valid_time:t demand_mw:f rrp_aud_mwh:f rooftop_pv_mw:f", """
    SELECT region, valid_time, demand_mw, CASE WHEN rrp_aud_mwh > -3 THEN rrp_aud_mwh END AS rrp_aud_mwh, rooftop_pv_mw FROM x_market""")
def _(t):
    m = t.market
    return market.combine(
        m.select("region", "valid_time", "demand_mw"),
        m.where(F.col("rrp_aud_mwh") > -3).select("region", "valid_time", "rrp_aud_mwh"),
        m.where(F.col("rooftop_pv_mw").isNotNull()).select("region", "valid_time", "rooftop_pv_mw"),
    )


@query("unit_prefix_match", "D2", "unit station exact:b", """
    WITH u AS (SELECT DISTINCT CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_brand || '_' || CAST(p_size % 5 AS VARCHAR) END AS unit FROM part),
    s AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE substr(p_brand, 1, 7) END AS station FROM part WHERE p_size < 20)
    SELECT unit, station, unit = station AS exact FROM (
      SELECT u.unit, s.station, row_number() OVER (PARTITION BY u.unit ORDER BY length(s.station) DESC) AS r FROM u JOIN s ON starts_with(u.unit, s.station)) WHERE r = 1""")
def _(t):
    part = t.t("part")
    units = part.select(F.when(F.col("p_size") % 5 == 0, F.col("p_brand")).otherwise(
        F.concat("p_brand", F.lit("_"), (F.col("p_size") % 5).cast("string"))).alias("unit")).distinct()
    codes = part.where(F.col("p_size") < 20).select(
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).otherwise(F.substring("p_brand", 1, 7)).alias("station")).distinct()
    return stations.match_units(units, codes)


@query("unit_resolution", "D2 A5", "unit station tech capacity_mw:f", """
    WITH u AS (SELECT DISTINCT p_brand || repeat('X', 40) || '_' || CAST(p_size % 7 AS VARCHAR) AS unit, p_brand, p_size % 7 AS k FROM part),
    s AS (SELECT DISTINCT p_brand || repeat('X', CAST(CASE WHEN p_size % 2 = 0 THEN 36 ELSE 2 END AS INTEGER)) AS station, CASE WHEN p_size % 2 = 0 THEN 'solar' ELSE 'wind' END AS tech,
          CASE WHEN p_size % 2 = 0 THEN CAST(40 AS DOUBLE) ELSE CAST(60 AS DOUBLE) END AS capacity_mw FROM part),
    c AS (SELECT u.unit, s.station, 0 AS a, length(s.station) AS n FROM u JOIN s ON starts_with(u.unit, s.station)
          UNION ALL SELECT u.unit, u.p_brand || 'XX', 1, 0 FROM u JOIN s ON s.station = u.p_brand || 'XX' WHERE k = 3)
    SELECT unit, s.station, s.tech, s.capacity_mw FROM (SELECT unit, station, row_number() OVER (PARTITION BY unit ORDER BY a DESC, n DESC) AS r FROM c) x JOIN s ON s.station = x.station WHERE r = 1""")
def _(t):
    part = t.t("part")
    units = part.select(F.concat("p_brand", F.repeat(F.lit("X"), 40), F.lit("_"), (F.col("p_size") % 7).cast("string")).alias("unit"), "p_brand", (F.col("p_size") % 7).alias("k")).distinct()
    long = F.col("p_size") % 2 == 0
    known = part.select(
        F.when(long, F.concat("p_brand", F.repeat(F.lit("X"), 36))).otherwise(F.concat("p_brand", F.lit("XX"))).alias("station"),
        F.array(F.when(long, F.lit("solar_utility")).otherwise(F.lit("wind"))).alias("fuels"), F.lit(True).alias("operating"),
        F.when(long, 40.0).otherwise(60.0).alias("capacity_mw"), F.lit(0.0).alias("latitude"), F.lit(0.0).alias("longitude"), F.lit("NSW").alias("state"),
    ).distinct()
    allocation = units.where("k IN (3, 4)").select(
        "unit", F.when(F.col("k") == 3, F.concat("p_brand", F.lit("XX"))).otherwise(F.lit("NOWHERE")).alias("station")
    )
    return stations.resolve_units(units.select("unit"), known, allocation).select("unit", "station", "tech", "capacity_mw")


@query("semi_and_anti_units", "D3 E4", "site_id valid_time:t power_mw:f", """
    SELECT site_id, valid_time, power_mw FROM x_hourly h WHERE site_id IN (SELECT site_id FROM x_sites WHERE tech = 'solar')
      AND site_id NOT IN (SELECT site_id FROM x_hourly GROUP BY site_id HAVING count(*) < 430)""")
def _(t):
    known = t.hourly.join(t.sites.where("tech = 'solar'").select("site_id"), "site_id", "left_semi")
    return fitting.drop_groups(known, fitting.thin_groups(t.hourly, ["site_id"], 430), ["site_id"])


@query("capped_power", "D4", "site_id valid_time:t power_mw:f capacity_mw:f", """
    SELECT g.site_id, valid_time, CASE WHEN power_mw IS NOT NULL THEN least(power_mw, capacity_mw / 3) END AS power_mw, capacity_mw / 3 AS capacity_mw
    FROM x_grid g JOIN x_sites s ON g.site_id = s.site_id""")
def _(t):
    return fitting.cap_power(t.grid, t.sites.select("site_id", (F.col("capacity_mw") / 3).alias("capacity_mw")))


@query("target_alignment", "D5 D6 C22", "site_id valid_time:t horizon_h:i denominator_mw:f power_mw:f target:f", """
    SELECT w.site_id, w.valid_time, w.horizon_h, s.capacity_mw AS denominator_mw, h.power_mw, CASE WHEN h.power_mw IS NOT NULL THEN least(greatest(h.power_mw / s.capacity_mw, 0), 1) END AS target
    FROM x_weather w JOIN x_sites s ON w.site_id = s.site_id LEFT JOIN x_hourly h ON h.site_id = w.site_id AND h.valid_time = w.valid_time""")
def _(t):
    return features.assemble_target(t.weather.select("site_id", "valid_time", "horizon_h"), t.hourly, t.sites)


@query("value_at_issue", "D7", "site_id valid_time:t horizon_h:i power_at_issue_mw:f", """
    SELECT e.site_id, e.valid_time, e.horizon_h, coalesce(h.power_mw, 0) AS power_at_issue_mw FROM x_eval e
    LEFT JOIN x_hourly h ON h.site_id = e.site_id AND h.valid_time = e.issue_time""")
def _(t):
    twice = t.hourly.withColumn("seq", F.lit(0)).unionByName(
        t.hourly.withColumn("power_mw", F.col("power_mw") + 1).withColumn("seq", F.lit(1)))
    return joins.value_at_issue(t.eval, twice, {"power_mw": "power_at_issue_mw"}, ["seq"])


_CLIM = """
    WITH tr AS (SELECT * FROM x_eval WHERE valid_time < TIMESTAMP '2024-01-18'),
    a AS (SELECT site_id, (dayofyear(valid_time) - 1) // 15 AS b, hour(valid_time) AS h, avg(actual_mw) AS m FROM tr GROUP BY ALL),
    c AS (SELECT site_id, avg(actual_mw) AS m FROM tr GROUP BY site_id)"""


@query("climatology_lookup", "D8 E37", "site_id valid_time:t horizon_h:i climatology_mw:f", f"""
    {_CLIM} SELECT e.site_id, e.valid_time, e.horizon_h, coalesce(a.m, c.m, 0) AS climatology_mw FROM x_eval e
    LEFT JOIN a ON a.site_id = e.site_id AND a.b = (dayofyear(e.valid_time) - 1) // 15 AND a.h = hour(e.valid_time) LEFT JOIN c ON c.site_id = e.site_id""")
def _(t):
    from gridloom.functions.clock import day_bin

    rows = t.eval
    cells, means = metrics.climatology(rows.where(F.col("valid_time") < "2024-01-18"))
    keyed = rows.withColumns({"doy_block": day_bin(F.col("valid_time"), 15), "hour": F.hour("valid_time")})
    return joins.with_fallback(keyed, cells, ["site_id", "doy_block", "hour"], means)


@query("gathered_variables", "D9 H1", "site_id valid_time:t a:f b:f c:f", """
    SELECT site_id, valid_time, CASE WHEN power_mw > 4 THEN power_mw END AS a, CASE WHEN power_mw > 8 THEN power_mw * 2 END AS b, CASE WHEN power_mw < 20 THEN power_mw * 3 END AS c
    FROM x_hourly WHERE power_mw > 4 OR power_mw < 20""")
def _(t):
    def part(keep, factor):
        return t.hourly.where(keep).select("site_id", "valid_time", (F.col("power_mw") * factor).alias("value"))

    p = F.col("power_mw")
    return joins.gather_variables({"a": part(p > 4, 1), "b": part(p > 8, 2), "c": part(p < 20, 3)}, ["site_id", "valid_time"])


@query("cell_fan_out", "D10 C8", "lat_cell:i lon_cell:i site_id owner", """
    WITH k AS (SELECT site_id, CAST(round_even(latitude / 7, 0) AS BIGINT) AS lat_cell, CAST(round_even(longitude / 7, 0) AS BIGINT) AS lon_cell FROM x_sites)
    SELECT k.*, min(site_id) OVER (PARTITION BY lat_cell, lon_cell) AS owner FROM k""")
def _(t):
    return joins.fan_out_cells(joins.distinct_cells(t.sites, 7.0), t.sites, 7.0)


@query("common_hours", "D11 H3", "region valid_time:t", """
    WITH r AS (SELECT * FROM x_leads WHERE horizon_h = 24), n AS (SELECT region, count(DISTINCT site_id) AS n FROM r GROUP BY region)
    SELECT r.region, r.valid_time FROM r JOIN n ON r.region = n.region JOIN x_market m ON m.region = r.region AND m.valid_time = r.valid_time
    GROUP BY r.region, r.valid_time, n.n HAVING count(r.actual_mw) = n.n""")
def _(t):
    return joins.common_hours(t.leads.where("horizon_h = 24"), t.market)


@query("load_centre_weather", "D14", "region valid_time:t demand_mw:f temp_2m_c:f", """
    WITH w AS (SELECT region, valid_time, arg_min(temp_2m_c, site_id) AS temp_2m_c FROM x_weather WHERE horizon_h = 24 GROUP BY ALL)
    SELECT m.region, m.valid_time, m.demand_mw, w.temp_2m_c FROM x_market m LEFT JOIN w ON w.region = m.region AND w.valid_time = m.valid_time""")
def _(t):
    centre = t.weather.where("horizon_h = 24").select("region", "valid_time", "site_id", "temp_2m_c")
    return features.centre_weather(t.market.select("region", "valid_time", "demand_mw"), centre, ["site_id"])


@query("horizon_expansion", "D15", "region valid_time:t horizon_h:i issue_time:t", """
    SELECT region, valid_time, h AS horizon_h, valid_time - to_hours(CAST(h AS INTEGER)) AS issue_time FROM x_market
    CROSS JOIN (VALUES (1), (2), (3), (6), (9), (12), (18), (24), (30), (36), (42), (48), (54), (60), (66), (72)) v(h)""")
def _(t):
    return features.expand_horizons(t.market.select("region", "valid_time"))


@query("aligned_price", "D16 F21", "region valid_time:t rrp_aud_mwh:f", """
    SELECT region, valid_time, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY region ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(p IGNORE NULLS) OVER (PARTITION BY region ORDER BY valid_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS rrp_aud_mwh
    FROM (SELECT region, valid_time, CASE WHEN rrp_aud_mwh > 2 THEN rrp_aud_mwh END AS p FROM x_market_grid)""")
def _(t):
    sparse = t.market.where(F.col("rrp_aud_mwh") > 2)
    return joins.align_price(t.market_grid.select("region", "valid_time"), sparse)


@query("forecast_outcome", "D17", "region valid_time:t horizon_h:i demand_mw:f actual_mw:f sites:i", """
    SELECT m.region, m.valid_time, o.horizon_h, m.demand_mw, o.actual_mw, o.sites FROM x_market m
    JOIN (SELECT region, valid_time, horizon_h, sum(actual_mw) AS actual_mw, count(*) AS sites FROM x_eval GROUP BY ALL) o ON o.region = m.region AND o.valid_time = m.valid_time""")
def _(t):
    return joins.forecast_vs_outcome(t.market.select("region", "valid_time", "demand_mw"), t.eval, ["horizon_h"])


@query("widening_lookup", "D18 E24", "region site_id valid_time:t horizon_h:i lower:f upper:f", """
    WITH w AS (SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS region, max(n_nationkey) / 10.0 AS a, max(CASE WHEN n_regionkey < 3 THEN n_nationkey END) / 20.0 AS b FROM nation WHERE n_regionkey <> 4 GROUP BY 1)
    SELECT e.region, site_id, valid_time, horizon_h, greatest(p10_mw - x, 0) AS lower, greatest(p90_mw + x, greatest(p10_mw - x, 0)) AS upper FROM (
      SELECT e.*, coalesce(CASE WHEN horizon_h BETWEEN 25 AND 48 THEN w.b END, w.a, 0) AS x FROM x_eval e LEFT JOIN w ON e.region = w.region) e""")
def _(t):
    from gridloom.functions.bands import widen

    n = t.t("nation").where("n_regionkey <> 4").groupBy(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("region")).agg(
        F.max("n_nationkey").alias("k"))
    table = n.select("region", F.lit("all").alias("lead_bucket"), (F.col("k") / 10.0).alias("widening")).unionByName(
        n.where("region < 'R3'").select("region", F.lit("25-48h").alias("lead_bucket"), (F.col("k") / 20.0).alias("widening")))
    rows = joins.widening_lookup(t.eval, table, ["region"])
    lower, upper = widen(F.col("p10_mw"), F.col("p90_mw"), F.col("widening"))
    return rows.withColumns({"lower": lower, "upper": upper})


@query("pooled_widening_lookup", "D18", "site_id valid_time:t horizon_h:i widening:f", """
    SELECT site_id, valid_time, horizon_h, CASE WHEN horizon_h = 24 THEN 1.5 ELSE 4 END AS widening FROM x_eval""")
def _(t):
    k = F.col("r_regionkey")
    table = t.t("region").select(F.when(k == 0, "1-24h").otherwise("all").alias("lead_bucket"), F.when(k == 0, 1.5).otherwise(k.cast("double")).alias("widening"))
    return joins.widening_lookup(t.eval, table, [])


@query("parameter_grid", "D19", "site_id ratio:f dispersion:f scaled:f", """
    SELECT site_id, r AS ratio, d AS dispersion, capacity_mw * r * d AS scaled FROM x_sites CROSS JOIN (VALUES (1.1), (1.25), (1.4)) a(r) CROSS JOIN (VALUES (0.8), (1.0), (1.2)) b(d)""")
def _(t):
    grid = joins.with_grid(t.sites.select("site_id", "capacity_mw"), {"ratio": [1.1, 1.25, 1.4], "dispersion": [0.8, 1.0, 1.2]})
    return grid.withColumn("scaled", F.col("capacity_mw") * F.col("ratio") * F.col("dispersion"))


@query("region_overview", "D20", "region capacity_mw:f sites:i nmae_pct:f hours:i available:b", """
    SELECT c.region, c.capacity_mw, c.sites, a.nmae_pct, h.hours, coalesce(h.hours > 0, false) AS available
    FROM (SELECT market_region AS region, sum(capacity_mw) AS capacity_mw, count(*) AS sites FROM x_sites GROUP BY 1) c
    LEFT JOIN (SELECT region, avg(abs(p50_mw - actual_mw) / capacity_mw) * 100 AS nmae_pct FROM x_eval WHERE region <> 'R2' GROUP BY 1) a ON a.region = c.region
    LEFT JOIN (SELECT region, count(*) AS hours FROM x_market WHERE region <> 'R4' GROUP BY 1) h ON h.region = c.region""")
def _(t):
    accuracy = metrics.score(t.eval.where("region <> 'R2'"), ["region"]).select("region", "nmae_pct")
    return joins.region_overview(t.sites, accuracy, t.market.where("region <> 'R4'"))


@query("history_overlap", "D21", "region days:i", """
    SELECT a.region, greatest(floor((epoch(least(a.hi, b.hi)) - epoch(greatest(a.lo, b.lo))) / 86400), 0) AS days
    FROM (SELECT region, min(valid_time) AS lo, max(valid_time) AS hi FROM x_market GROUP BY 1) a
    JOIN (SELECT region, min(valid_time) AS lo, max(valid_time) AS hi FROM x_hourly WHERE valid_time < TIMESTAMP '2024-01-20' GROUP BY 1) b ON a.region = b.region""")
def _(t):
    return joins.overlap_days(t.market, t.hourly.where(F.col("valid_time") < "2024-01-20"))


@query("envelope_lookup", "D22 U2", "site_id valid_time:t clearsky_mw:f", """
    WITH e AS (SELECT site_id, (dayofyear(valid_time) - 1) // 5 AS b, hour(valid_time) AS h, quantile_cont(power_mw, 0.95) AS q, count(*) AS n FROM x_hourly GROUP BY ALL)
    SELECT g.site_id, g.valid_time, coalesce(e.q, 0) AS clearsky_mw FROM x_grid g LEFT JOIN e ON e.n >= 3 AND e.site_id = g.site_id AND e.b = (dayofyear(g.valid_time) - 1) // 5 AND e.h = hour(g.valid_time)""")
def _(t):
    return joins.envelope_lookup(t.grid, fitting.output_envelope(t.hourly))


_REQUESTS = """
    WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE 'S' || CAST(c_custkey % 10 AS VARCHAR) END AS site_id,
        CASE WHEN c_custkey % 2 = 0 THEN 'solar' END AS tech, CASE WHEN c_custkey % 4 <> 1 THEN abs(c_acctbal) END AS capacity_mw,
        CASE WHEN c_custkey % 3 = 0 THEN -30.0 END AS latitude, CASE WHEN c_custkey % 3 = 0 THEN 140.0 END AS longitude FROM customer)"""


def _requests(t):
    k = F.col("c_custkey")
    return t.t("customer").select(
        "c_custkey", F.when(k % 3 == 0, None).when(k % 7 == 0, "nowhere").otherwise(F.concat(F.lit("S"), (k % 10).cast("string"))).alias("site_id"),
        F.when(k % 2 == 0, "solar").alias("tech"), F.when(k % 4 != 1, F.abs("c_acctbal")).alias("capacity_mw"),
        F.when(k % 3 == 0, -30.0).alias("latitude"), F.when(k % 3 == 0, 140.0).alias("longitude"),
    )


@query("resolved_requests", "C36", "c_custkey:i site_id tech capacity_mw:f latitude:f longitude:f ad_hoc:b", f"""
    {_REQUESTS} SELECT c_custkey, r.site_id, coalesce(r.tech, s.tech) AS tech, coalesce(r.capacity_mw, s.capacity_mw) AS capacity_mw,
        coalesce(r.latitude, s.latitude) AS latitude, coalesce(r.longitude, s.longitude) AS longitude, r.site_id IS NULL AS ad_hoc
    FROM r LEFT JOIN x_sites s ON r.site_id = s.site_id WHERE s.site_id IS NOT NULL OR (r.site_id IS NULL AND r.tech IS NOT NULL AND r.capacity_mw IS NOT NULL)""")
def _(t):
    return joins.resolve_requests(_requests(t), t.sites)[0]


@query("rejected_requests", "C36", "c_custkey:i site_id reason", f"""
    {_REQUESTS} SELECT c_custkey, r.site_id, CASE WHEN r.site_id IS NULL THEN 'incomplete coordinates' ELSE 'unknown site' END AS reason
    FROM r LEFT JOIN x_sites s ON r.site_id = s.site_id WHERE NOT (s.site_id IS NOT NULL OR (r.site_id IS NULL AND r.tech IS NOT NULL AND r.capacity_mw IS NOT NULL))""")
def _(t):
    return joins.resolve_requests(_requests(t), t.sites)[1]


@query("union_by_name", "H1", "site_id valid_time:t lead:i p50_mw:f extra:f", """
    SELECT site_id, valid_time, 24 AS lead, p50_mw, NULL AS extra FROM x_leads WHERE horizon_h = 24 UNION ALL SELECT site_id, valid_time, 48, p50_mw, 1.0 FROM x_leads WHERE horizon_h = 48""")
def _(t):
    a = t.leads.where("horizon_h = 24").select("site_id", "valid_time", F.lit(24).alias("lead"), "p50_mw")
    b = t.leads.where("horizon_h = 48").select("site_id", "valid_time", F.lit(48).alias("lead"), "p50_mw", F.lit(1.0).alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@query("missing_sites", "H2", "site_id", "SELECT site_id FROM x_sites EXCEPT SELECT site_id FROM x_hourly")
def _(t):
    return t.sites.select("site_id").subtract(t.hourly.select("site_id"))


@query("shared_sites", "H3", "site_id", "SELECT site_id FROM x_sites WHERE capacity_mw > 40 INTERSECT SELECT site_id FROM x_hourly")
def _(t):
    return t.sites.where("capacity_mw > 40").select("site_id").intersect(t.hourly.select("site_id"))


@query("distinct_regions", "H4", "region", "SELECT market_region AS region FROM x_sites UNION SELECT region FROM x_market")
def _(t):
    return t.sites.select(F.col("market_region").alias("region")).union(t.market.select("region")).distinct()


@query("deduplicated_readings", "F1", "user_id:i hour:t event_id:i value:f", """
    SELECT user_id, date_trunc('hour', ts) AS hour, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL""")
def _(t):
    rows = t.events.select("user_id", F.date_trunc("hour", "ts").alias("hour"), "event_id", "value")
    return keep_one(rows, ["user_id", "hour"], ["event_id"], keep="last")


@query("demand_feature_table", "L6 F7 F8 F9 D14 D15", "region valid_time:t horizon_h:i target:f load_lag_1h:f load_lag_168h:f rooftop_lag_24h:f load_mean_24h:f load_std_24h:f load_mean_168h:f cooling_degrees_24h:f is_holiday:f hour_sin:f", """
    WITH w AS (SELECT region, valid_time, arg_min(temp_2m_c, site_id) AS temp FROM x_weather WHERE horizon_h = 24 GROUP BY ALL),
    g AS (SELECT m.region, m.valid_time, m.demand_mw, m.rooftop_pv_mw, greatest(w.temp - 18, 0) AS cool, w.temp FROM x_market_grid m LEFT JOIN w ON w.region = m.region AND w.valid_time = m.valid_time),
    k AS (SELECT *, lag(demand_mw, 1) OVER o AS l1, lag(demand_mw, 168) OVER o AS l168, lag(rooftop_pv_mw, 24) OVER o AS r24,
        CASE WHEN count(demand_mw) OVER a >= 6 THEN avg(demand_mw) OVER a END AS m24, CASE WHEN count(demand_mw) OVER a >= 2 THEN stddev_samp(demand_mw) OVER a END AS s24,
        CASE WHEN count(demand_mw) OVER b >= 42 THEN avg(demand_mw) OVER b END AS m168, avg(CASE WHEN temp IS NOT NULL THEN cool END) OVER a AS c24
      FROM g WINDOW o AS (PARTITION BY region ORDER BY valid_time), a AS (PARTITION BY region ORDER BY valid_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW),
        b AS (PARTITION BY region ORDER BY valid_time ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)),
    x AS (SELECT k.*, h, (valid_time AT TIME ZONE 'UTC') AT TIME ZONE CASE region WHEN 'R0' THEN 'Australia/Sydney' WHEN 'R1' THEN 'Australia/Brisbane' WHEN 'R2' THEN 'Australia/Adelaide' WHEN 'R3' THEN 'Australia/Hobart' ELSE 'Australia/Melbourne' END AS lt
      FROM k CROSS JOIN (VALUES (1), (2), (3), (6), (9), (12), (18), (24), (30), (36), (42), (48), (54), (60), (66), (72)) v(h) WHERE demand_mw IS NOT NULL)
    SELECT x.region, x.valid_time, x.h AS horizon_h, x.demand_mw AS target, i.l1 AS load_lag_1h, i.l168 AS load_lag_168h, i.r24 AS rooftop_lag_24h, i.m24 AS load_mean_24h, i.s24 AS load_std_24h,
        i.m168 AS load_mean_168h, x.c24 AS cooling_degrees_24h, CASE WHEN strftime(x.lt, '%m-%d') IN ('01-01', '01-26') THEN 1 ELSE 0 END AS is_holiday, sin(2 * CAST(pi() AS DOUBLE) * hour(x.lt) / 24) AS hour_sin
    FROM x LEFT JOIN k i ON i.region = x.region AND i.valid_time = x.valid_time - to_hours(CAST(x.h AS INTEGER))""")
def _(t):
    centre = keep_one(t.weather.where("horizon_h = 24").select("region", "valid_time", "site_id", "temp_2m_c", "cloud_total", "wind_speed_10m", "ghi_wm2"),
                      ["region", "valid_time"], ["site_id"]).drop("site_id")
    return features.demand_features(t.market_grid, centre, REGION_CLOCKS, features.HORIZONS)
