"""Catalogue: aggregations, fits, metrics and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import clock
from gridloom.operators import calibration, fitting, metrics, planning, seasonal
from gridloom.operators.quantiles import exact_quantiles
from gridloom.operators.resample import hourly_mean
from gridloom.plans.adapters import REGION_CLOCKS
from gridloom.plans.registry import query
from gridloom.plans.solar_sql import PLANT_FIT


@query("hourly_mean", "E1", "site_id valid_time:t power_mw:f", "SELECT site_id, valid_time, power_mw FROM x_hourly")
def _(t):
    return t.hourly


@query("hourly_market_mean", "E1", "event_type valid_time:t v:f", """
    SELECT event_type, date_trunc('hour', ts) AS valid_time, avg(value - 10) AS v FROM events WHERE event_id % 29 <> 0 GROUP BY ALL""")
def _(t):
    rows = t.events.select("event_type", F.when(F.col("event_id") % 29 != 0, F.col("ts")).alias("ts"), (F.col("value") - 10).alias("x"))
    return hourly_mean(rows, ["event_type"], "ts", "x", out="v", floor_zero=False)


@query("effective_capacity", "E2", "site_id registered_mw:f observed_mw:f capacity_mw:f kept_registered:b", """
    SELECT h.site_id, s.capacity_mw AS registered_mw, q AS observed_mw, CASE WHEN k THEN s.capacity_mw ELSE q END AS capacity_mw, k AS kept_registered
    FROM (SELECT h.site_id, s.capacity_mw, q, q <= 0 OR coalesce(q / s.capacity_mw BETWEEN 0.8 AND 1.1, false) AS k FROM (SELECT site_id, quantile_cont(power_mw, 0.995) AS q FROM x_hourly GROUP BY 1) h JOIN x_sites s ON s.site_id = h.site_id) h
    JOIN x_sites s ON s.site_id = h.site_id""")
def _(t):
    return fitting.effective_capacity(t.hourly, t.sites.select("site_id", F.col("capacity_mw").alias("registered_mw")))


@query("profile_check", "E3", "site_id tech mean_cf:f daylight_share:f accepted:b", """
    SELECT site_id, tech, mean_cf, share AS daylight_share, mean_cf BETWEEN 0.03 AND CASE tech WHEN 'solar' THEN 0.45 ELSE 0.65 END AND (tech <> 'solar' OR share >= 0.95) AS accepted FROM (
    SELECT site_id, tech, avg(cf) AS mean_cf, sum(CASE WHEN up > sin(radians(CAST(5 AS DOUBLE))) THEN cf ELSE 0 END) / sum(cf) AS share FROM (
    SELECT *, power_mw / capacity_mw AS cf, sin(radians(latitude)) * sin(dec) + cos(radians(latitude)) * cos(dec) * cos(radians((hour(ts) + longitude / 15 + (9.87 * sin(2 * b) - 7.53 * cos(b) - 1.5 * sin(b)) / 60 - 12) * 15)) AS up FROM (
    SELECT h.site_id, s.tech, h.valid_time AS ts, h.power_mw, s.capacity_mw, s.latitude, s.longitude, radians(23.45 * sin(radians((dayofyear(h.valid_time) + 284) * 360 / 365.0))) AS dec,
        radians((dayofyear(h.valid_time) - 81) * 360 / 364.0) AS b FROM x_hourly h JOIN x_sites s ON s.site_id = h.site_id)) GROUP BY ALL)""")
def _(t):
    return fitting.profile_check(t.hourly.select("site_id", "valid_time", "power_mw"), t.sites)


@query("thin_groups", "E4", "site_id n:i", "SELECT site_id, count(*) AS n FROM x_hourly GROUP BY 1 HAVING count(*) < 430")
def _(t):
    return fitting.thin_groups(t.hourly, ["site_id"], 430)


@query("output_envelope", "E6", "site_id doy_bin:i hour:i n:i envelope_mw:f", """
    SELECT site_id, (dayofyear(valid_time) - 1) // 5 AS doy_bin, hour(valid_time) AS hour, count(*) AS n, CASE WHEN count(*) >= 3 THEN quantile_cont(power_mw, 0.95) END AS envelope_mw FROM x_hourly GROUP BY ALL""")
def _(t):
    return fitting.output_envelope(t.hourly)


@query("month_envelope", "E6", "site_id month:i hour:i n:i observed_mw:f", """
    SELECT site_id, month(valid_time) AS month, hour(valid_time) AS hour, count(*) AS n, quantile_cont(power_mw, 0.98) AS observed_mw FROM x_hourly GROUP BY ALL HAVING count(*) >= 5""")
def _(t):
    return fitting.month_envelope(t.hourly)


@query("smoothed_envelope", "E6 F12 F13", "site_id doy_bin:i hour:i envelope_mw:f", """
    WITH e AS (SELECT site_id, (dayofyear(valid_time) - 1) // 5 AS b, hour(valid_time) AS h, CASE WHEN count(*) >= 3 THEN quantile_cont(power_mw, 0.95) END AS q FROM x_hourly GROUP BY ALL),
    f AS (SELECT s.site_id, s.b, v.h, e.q FROM (SELECT DISTINCT site_id, b FROM e) s CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h) v LEFT JOIN e ON e.site_id = s.site_id AND e.b = s.b AND e.h = v.h),
    m AS (SELECT a.site_id, a.b, a.h, avg(c.q) AS q FROM f a JOIN f c ON c.site_id = a.site_id AND c.h = a.h AND (abs(c.b - a.b) <= 1 OR abs(c.b - a.b) = 73) GROUP BY ALL),
    p AS (SELECT *, last_value(q IGNORE NULLS) OVER w1 AS v0, last_value(CASE WHEN q IS NOT NULL THEN h END IGNORE NULLS) OVER w1 AS p0,
        first_value(q IGNORE NULLS) OVER w2 AS v1, first_value(CASE WHEN q IS NOT NULL THEN h END IGNORE NULLS) OVER w2 AS p1 FROM m
        WINDOW w1 AS (PARTITION BY site_id, b ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY site_id, b ORDER BY h ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT site_id, b AS doy_bin, h AS hour, coalesce(q, v0 + (v1 - v0) * (h - p0) / nullif(p1 - p0, 0), v0, v1, 0) AS envelope_mw FROM p""")
def _(t):
    return fitting.smooth_envelope(fitting.output_envelope(t.hourly))


@query("longitude_fit", "E7", "site_id longitude:f", """
    SELECT site_id, ((12 - ((atan2(s, c) + 2 * CAST(pi() AS DOUBLE)) % (2 * CAST(pi() AS DOUBLE))) * 24 / (2 * CAST(pi() AS DOUBLE))) * 15 + 180 + 360) % 360 - 180 AS longitude FROM (
      SELECT site_id, sum(power_mw * sin(2 * CAST(pi() AS DOUBLE) * hour(valid_time) / 24)) AS s, sum(power_mw * cos(2 * CAST(pi() AS DOUBLE) * hour(valid_time) / 24)) AS c FROM x_hourly GROUP BY 1)""")
def _(t):
    return fitting.longitude_from_output(t.hourly)


@query("daylength_signature", "E8 F12 F13", "site_id doy:i hours:f", """
    WITH d AS (SELECT g.site_id, CAST(g.valid_time AS DATE) AS d, sum(CASE WHEN power_mw > t THEN 1 ELSE 0 END) AS h FROM x_grid g JOIN (SELECT site_id, max(power_mw) * 0.01 AS t FROM x_hourly GROUP BY 1) p ON p.site_id = g.site_id GROUP BY ALL),
    y AS (SELECT site_id, dayofyear(d) AS doy, avg(h) AS q FROM d GROUP BY ALL),
    s AS (SELECT site_id, unnest(generate_series(1, 366)) AS doy FROM (SELECT DISTINCT site_id FROM y)),
    f AS (SELECT s.site_id, s.doy, y.q FROM s LEFT JOIN y ON y.site_id = s.site_id AND y.doy = s.doy),
    p AS (SELECT *, last_value(q IGNORE NULLS) OVER w1 AS v0, last_value(CASE WHEN q IS NOT NULL THEN doy END IGNORE NULLS) OVER w1 AS p0,
        first_value(q IGNORE NULLS) OVER w2 AS v1, first_value(CASE WHEN q IS NOT NULL THEN doy END IGNORE NULLS) OVER w2 AS p1 FROM f
        WINDOW w1 AS (PARTITION BY site_id ORDER BY doy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), w2 AS (PARTITION BY site_id ORDER BY doy ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    i AS (SELECT site_id, doy, coalesce(q, v0 + (v1 - v0) * (doy - p0) / nullif(p1 - p0, 0), v0, v1) AS q FROM p),
    t AS (SELECT site_id, doy + k * 366 AS x, doy, k, q FROM i CROSS JOIN (VALUES (-1), (0), (1)) v(k))
    SELECT site_id, doy, m AS hours FROM (SELECT *, avg(q) OVER (PARTITION BY site_id ORDER BY x ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM t) WHERE k = 0""")
def _(t):
    return fitting.daylength_signature(t.grid)


@query("location_fit", "E9 E7", "site_id longitude:f latitude:f rmse_h:f accepted:b tilt_deg:f azimuth_deg:f")
def _(t):
    return fitting.fit_locations(t.grid.where("tech = 'solar'"))


@query("plant_fit", "E10", "site_id mount dc_ac_ratio:f rmse_mw:f rmse_pct_capacity:f", PLANT_FIT)
def _(t):
    return fitting.fit_plant(t.hourly.where("tech = 'solar'"), t.sites)


@query("region_peak", "E11", "region peak_mw:f", "SELECT region, quantile_cont(demand_mw, 0.999) AS peak_mw FROM x_market GROUP BY 1")
def _(t):
    from gridloom.operators.features import region_peaks

    return region_peaks(t.market)


@query("dispatchable_headroom", "E12", "region headroom_mw:f", """
    SELECT region, greatest(quantile_cont(available_generation_mw - coalesce(solar_uigf_mw, 0) - coalesce(wind_uigf_mw, 0), 0.25), 0) AS headroom_mw FROM x_market GROUP BY 1""")
def _(t):
    return fitting.dispatchable_headroom(t.market)


@query("exchange_limits", "E13", "region export_limit_mw:f import_limit_mw:f", """
    SELECT region, CASE WHEN quantile_cont(net_interchange_mw, 0.99) > 0 THEN quantile_cont(net_interchange_mw, 0.99) ELSE 1000000 END AS export_limit_mw,
           CASE WHEN -quantile_cont(net_interchange_mw, 0.01) > 0 THEN -quantile_cont(net_interchange_mw, 0.01) ELSE 1000000 END AS import_limit_mw FROM x_market GROUP BY 1""")
def _(t):
    return fitting.exchange_limits(t.market)


_GRID_SQL = """
    WITH g AS (SELECT region, month, local_hour, count(*) AS n, avg(surplus_mw) AS mean_surplus_mw, avg(residual_mw) AS mean_residual_mw, avg(CAST(surplus_mw > 0 AS INTEGER)) AS surplus_share,
        CASE WHEN sum(demand_mw) > 0 THEN sum(renewable_mw) / sum(demand_mw) END AS renewable_share, median(rrp_aud_mwh) AS median_price FROM x_balance GROUP BY ALL)"""


@query("month_hour_grid", "E14 E15", "region month:i local_hour:i n:i mean_surplus_mw:f mean_residual_mw:f surplus_share:f renewable_share:f median_price:f", f"{_GRID_SQL} SELECT * FROM g")
def _(t):
    return seasonal.month_hour_grids(seasonal.local_balance(t.history, REGION_CLOCKS))


@query("dense_event_grid", "E14", "region month:i local_hour:i n:i mean_residual_mw:f", """
    WITH c AS (SELECT region, m AS month, h AS local_hour FROM (SELECT DISTINCT region FROM x_market) CROSS JOIN (SELECT unnest(generate_series(1, 12)) AS m) CROSS JOIN (SELECT unnest(generate_series(0, 23)) AS h)),
    g AS (SELECT region, month(valid_time) AS month, hour(valid_time) AS local_hour, count(*) AS n, avg(demand_mw - coalesce(solar_uigf_mw, 0) - coalesce(wind_uigf_mw, 0)) AS r FROM x_market GROUP BY ALL)
    SELECT c.*, g.n, g.r AS mean_residual_mw FROM c LEFT JOIN g ON g.region = c.region AND g.month = c.month AND g.local_hour = c.local_hour""")
def _(t):
    from gridloom.sources.market import with_curtailment

    block = seasonal.local_balance(with_curtailment(t.market), {r: "UTC" for r in REGION_CLOCKS})
    return seasonal.dense_grid(seasonal.month_hour_grids(block))


@query("grid_matrix", "E14 E32", "region month:i h0:f h11:f h23:f", f"""
    {_GRID_SQL} SELECT region, month, max(CASE WHEN local_hour = 0 THEN mean_surplus_mw END) AS h0, max(CASE WHEN local_hour = 11 THEN mean_surplus_mw END) AS h11, max(CASE WHEN local_hour = 23 THEN mean_surplus_mw END) AS h23 FROM g GROUP BY ALL""")
def _(t):
    wide = seasonal.grid_matrix(seasonal.month_hour_grids(seasonal.local_balance(t.history, REGION_CLOCKS)), "mean_surplus_mw")
    return wide.select("region", "month", F.col("0").alias("h0"), F.col("11").alias("h11"), F.col("23").alias("h23"))


@query("energy_share", "E15", "region share:f", "SELECT region, CASE WHEN sum(demand_mw) > 0 THEN sum(renewable_mw) / sum(demand_mw) END AS share FROM x_balance GROUP BY 1")
def _(t):
    return fitting.energy_share(seasonal.local_balance(t.history, REGION_CLOCKS), ["region"])


@query("monthly_summary", "E16 G4", "region month:i surplus_hours_per_year:f surplus_mwh_per_year:f curtailed_mwh_per_year:f mean_demand_mw:f renewable_share:f mean_price:f negative_price_hours_per_year:f is_peak_month:b", """
    WITH y AS (SELECT region, floor((epoch(max(valid_time)) - epoch(min(valid_time))) / 86400) / 365.25 AS y FROM x_history GROUP BY 1)
    SELECT b.region, month, count(CASE WHEN surplus_mw > 0 THEN 1 END) / max(y) AS surplus_hours_per_year, sum(surplus_mw) / max(y) AS surplus_mwh_per_year, sum(curtailed_mw) / max(y) AS curtailed_mwh_per_year,
        avg(demand_mw) AS mean_demand_mw, sum(renewable_mw) / sum(demand_mw) AS renewable_share, avg(rrp_aud_mwh) AS mean_price, count(CASE WHEN rrp_aud_mwh < 0 THEN 1 END) / max(y) AS negative_price_hours_per_year,
        row_number() OVER (PARTITION BY b.region ORDER BY sum(surplus_mw) DESC, month) = 1 AS is_peak_month
    FROM x_balance b JOIN y ON y.region = b.region GROUP BY b.region, month""")
def _(t):
    return seasonal.monthly_summary(seasonal.local_balance(t.history, REGION_CLOCKS))


@query("daily_totals", "E17", "region date:d renewable_mwh:f demand_mwh:f residual_mwh:f share:f", """
    SELECT region, date, sum(renewable_mw) AS renewable_mwh, sum(demand_mw) AS demand_mwh, sum(residual_mw) AS residual_mwh, coalesce(sum(renewable_mw) / nullif(sum(demand_mw), 0), 1) AS share FROM x_balance GROUP BY ALL""")
def _(t):
    return seasonal.daily_totals(seasonal.local_balance(t.history, REGION_CLOCKS))


_METRIC_SQL = """count(*) AS n, avg(abs(p50_mw - actual_mw) / capacity_mw) * 100 AS nmae_pct, sqrt(avg(power((p50_mw - actual_mw) / capacity_mw, 2))) * 100 AS nrmse_pct,
    avg((p50_mw - actual_mw) / capacity_mw) * 100 AS bias_pct, 1 - sum(power(p50_mw - actual_mw, 2)) / nullif(var_pop(actual_mw) * count(*), 0) AS r2"""
_BUCKET_SQL = "CASE WHEN horizon_h <= 24 THEN '1-24h' WHEN horizon_h <= 48 THEN '25-48h' ELSE '49-72h' END"


@query("site_metrics", "E18 E35", "site_id n:i nmae_pct:f nrmse_pct:f bias_pct:f r2:f", f"SELECT site_id, {_METRIC_SQL} FROM x_eval GROUP BY 1")
def _(t):
    return metrics.score(t.eval, ["site_id"])


@query("lead_bucket_metrics", "E19 E18", "lead_bucket n:i nmae_pct:f bias_pct:f r2:f coverage:f mean_width:f pinball:f", f"""
    WITH x AS (SELECT *, actual_mw / capacity_mw AS y FROM x_eval)
    SELECT coalesce(b, 'all') AS lead_bucket, {_METRIC_SQL}, avg(CAST(actual_mw BETWEEN p10_mw AND p90_mw AS INTEGER)) AS coverage, avg((p90_mw - p10_mw) / capacity_mw) AS mean_width,
      (avg(greatest((y - p10_mw / capacity_mw) * 0.1, (y - p10_mw / capacity_mw) * -0.9)) + avg(greatest((y - p50_mw / capacity_mw) * 0.5, (y - p50_mw / capacity_mw) * -0.5)) + avg(greatest((y - p90_mw / capacity_mw) * 0.9, (y - p90_mw / capacity_mw) * -0.1))) / 3 AS pinball
    FROM (SELECT *, {_BUCKET_SQL} AS b FROM x) GROUP BY ROLLUP (b)""")
def _(t):
    return metrics.by_lead_bucket(t.eval)


@query("skill_table", "E20", "method n:i nmae_pct:f skill:f", """
    WITH l AS (SELECT 'p50' AS method, p50_mw AS p, actual_mw, capacity_mw FROM x_eval UNION ALL SELECT 'p10', p10_mw, actual_mw, capacity_mw FROM x_eval UNION ALL SELECT 'p90', p90_mw, actual_mw, capacity_mw FROM x_eval),
    s AS (SELECT method, count(*) AS n, avg(abs(p - actual_mw) / capacity_mw) * 100 AS nmae_pct FROM l GROUP BY 1)
    SELECT s.*, 1 - s.nmae_pct / r.nmae_pct AS skill FROM s CROSS JOIN (SELECT nmae_pct FROM s WHERE method = 'p90') r""")
def _(t):
    return metrics.with_skill(metrics.score_methods(t.eval, {"p50": "p50_mw", "p10": "p10_mw", "p90": "p90_mw"}), "p90")


_SCORES = "SELECT *, greatest(p10_mw - actual_mw, actual_mw - p90_mw) / capacity_mw AS score FROM x_eval"


def _scores(t):
    gap = calibration.conformity(F.col("actual_mw"), F.col("p10_mw"), F.col("p90_mw"))
    return t.eval.withColumn("score", gap / F.col("capacity_mw"))


@query("conformal_widening", "E21", "tech n:i widening:f", f"""
    SELECT tech, n, score AS widening FROM (SELECT *, row_number() OVER (PARTITION BY tech ORDER BY score) AS r, count(*) OVER (PARTITION BY tech) AS n FROM ({_SCORES}))
    WHERE r = ceil((n - 1) * (least(1.0, ceil((n + 1) * 0.8) / n)) - 0.000001) + 1""")
def _(t):
    return calibration.conformal_widening(_scores(t), ["tech"])


@query("bucket_widening", "E22", "tech lead_bucket n:i widening:f", f"""
    WITH s AS (SELECT tech, score, {_BUCKET_SQL} AS lead_bucket FROM ({_SCORES}) UNION ALL SELECT tech, score, 'all' FROM ({_SCORES}))
    SELECT tech, lead_bucket, n, score AS widening FROM (SELECT *, row_number() OVER (PARTITION BY tech, lead_bucket ORDER BY score) AS r, count(*) OVER (PARTITION BY tech, lead_bucket) AS n FROM s)
    WHERE r = ceil((n - 1) * (least(1.0, ceil((n + 1) * 0.8) / n)) - 0.000001) + 1 AND (lead_bucket = 'all' OR n >= 500)""")
def _(t):
    return calibration.widening_by_bucket(_scores(t), ["tech"])


@query("region_calibration", "E23 E22", "region lead_bucket widening:f shift:f", f"""
    WITH m AS (SELECT region, median(actual_mw - (p10_mw + p90_mw) / 2) AS shift FROM x_eval GROUP BY 1),
    z AS (SELECT e.region, {_BUCKET_SQL} AS b, greatest(p10_mw + shift - actual_mw, actual_mw - p90_mw - shift) AS score, shift FROM x_eval e JOIN m ON m.region = e.region),
    s AS (SELECT region, b AS lead_bucket, score, shift FROM z UNION ALL SELECT region, 'all', score, shift FROM z)
    SELECT region, lead_bucket, score AS widening, shift FROM (SELECT *, row_number() OVER (PARTITION BY region, lead_bucket ORDER BY score) AS r, count(*) OVER (PARTITION BY region, lead_bucket) AS n FROM s)
    WHERE r = ceil((n - 1) * (least(1.0, ceil((n + 1) * 0.8) / n)) - 0.000001) + 1 AND (lead_bucket = 'all' OR n >= 500)""")
def _(t):
    rows = t.eval.select("region", "horizon_h", F.col("actual_mw").alias("actual"), F.col("p10_mw").alias("lower"), F.col("p90_mw").alias("upper"))
    return calibration.region_calibration(rows)


@query("exact_quantiles", "E21 E2", "l_returnflag level:f n:i quantile:f", """
    SELECT l_returnflag, 0.005 AS level, count(*) AS n, quantile_cont(l_extendedprice, 0.005) AS quantile FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 0.5, count(*), quantile_cont(l_extendedprice, 0.5) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 0.995, count(*), quantile_cont(l_extendedprice, 0.995) FROM lineitem GROUP BY 1""")
def _(t):
    return exact_quantiles(t.t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.005, 0.5, 0.995])


@query("calibrated_coverage", "E24", "region n:i coverage:f", """
    SELECT region, count(*) AS n, avg(CAST(actual_mw >= greatest(p10_mw - 3, 0) AND actual_mw <= greatest(p90_mw + 3, greatest(p10_mw - 3, 0)) AS INTEGER)) AS coverage FROM x_eval GROUP BY 1""")
def _(t):
    from gridloom.functions.bands import widen

    lower, upper = widen(F.col("p10_mw"), F.col("p90_mw"), F.lit(3.0))
    return calibration.empirical_coverage(t.eval.withColumns({"lo": lower, "hi": upper}), ["region"], "actual_mw", "lo", "hi")


@query("brier_skill", "E30", "event_type n:i base_rate:f brier:f brier_climatology:f skill:f", """
    SELECT event_type, count(*) AS n, avg(o) AS base_rate, avg((p - o) * (p - o)) AS brier, avg(o) * (1 - avg(o)) AS brier_climatology,
        CASE WHEN avg(o) * (1 - avg(o)) >= 0.000000001 THEN 1 - avg((p - o) * (p - o)) / (avg(o) * (1 - avg(o))) END AS skill
    FROM (SELECT event_type, CAST(user_id % 11 AS DOUBLE) / 10 AS p, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value > 10 AS INTEGER) END AS o FROM events) GROUP BY 1""")
def _(t):
    return metrics.brier(_outcomes(t), ["event_type"], "p", "o")


def _outcomes(t):
    return t.events.select("event_type", ((F.col("user_id") % 11) / 10.0).alias("p"),
                           F.when(F.col("event_type") == "view", 0.0).otherwise((F.col("value") > 10).cast("double")).alias("o"))


@query("reliability_bins", "E30", "event_type bin:i n:i predicted:f observed:f", """
    SELECT event_type, CAST(least(floor(p * 5), 4) AS BIGINT) AS bin, count(*) AS n, avg(p) AS predicted, avg(o) AS observed
    FROM (SELECT event_type, CAST(user_id % 11 AS DOUBLE) / 10 AS p, CASE WHEN event_type = 'view' THEN 0 ELSE CAST(value > 10 AS INTEGER) END AS o FROM events) GROUP BY ALL""")
def _(t):
    return metrics.reliability(_outcomes(t), ["event_type"], "p", "o")


@query("site_spread", "E35", "sites:i lowest:f median:f p90:f highest:f", f"""
    SELECT count(*) AS sites, min(nmae_pct) AS lowest, quantile_cont(nmae_pct, 0.5) AS median, quantile_cont(nmae_pct, 0.9) AS p90, max(nmae_pct) AS highest FROM (SELECT site_id, {_METRIC_SQL} FROM x_eval GROUP BY 1)""")
def _(t):
    return metrics.site_spread(metrics.score(t.eval, ["site_id"]))


@query("model_comparison", "E36", "lead_bucket n:i current_nmae:f baseline_nmae:f gain_pp:f", f"""
    SELECT {_BUCKET_SQL} AS lead_bucket, count(*) AS n, avg(abs(p50_mw - actual_mw) / capacity_mw) * 100 AS current_nmae, avg(abs(p90_mw - actual_mw) / capacity_mw) * 100 AS baseline_nmae,
        avg(abs(p90_mw - actual_mw) / capacity_mw) * 100 - avg(abs(p50_mw - actual_mw) / capacity_mw) * 100 AS gain_pp FROM x_eval GROUP BY 1""")
def _(t):
    other = t.eval.withColumn("p50_mw", F.col("p90_mw"))
    return metrics.compare_models(t.eval, other, ["site_id", "valid_time", "horizon_h"])


@query("holdout_mismatch", "E36", "site_id only_in", """
    SELECT DISTINCT site_id, CASE WHEN CAST(substr(site_id, 2) AS INTEGER) < 3 THEN 'baseline' ELSE 'current' END AS only_in FROM x_eval WHERE CAST(substr(site_id, 2) AS INTEGER) < 3 OR CAST(substr(site_id, 2) AS INTEGER) > 8""")
def _(t):
    k = F.substring("site_id", 2, 12).cast("int")
    return metrics.holdout_mismatch(t.eval.where(k >= 3), t.eval.where(k <= 8))


@query("capacity_rollup", "E39", "region tech capacity_mw:f sites:i", """
    SELECT market_region AS region, coalesce(tech, 'total') AS tech, sum(capacity_mw) AS capacity_mw, count(*) AS sites FROM x_sites GROUP BY GROUPING SETS ((market_region, tech), (market_region))""")
def _(t):
    return fitting.capacity_rollup(t.sites)


@query("policy_costs", "E40", "region windows:i hours:i wait_and_see:f stochastic:f expected_value:f vss_total:f evpi_total:f vss_per_year:f evpi_per_year:f positive_vss:i decision_differed:i", """
    WITH c AS (SELECT r_name AS region, 72 AS h, o_totalprice AS ws, o_totalprice * 1.1 AS st, o_totalprice * 1.1 + CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 ELSE 0 END AS ev, o_orderpriority AS a, o_orderstatus AS b, o_orderkey
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT region, count(*) AS windows, sum(h) AS hours, avg(ws) AS wait_and_see, avg(st) AS stochastic, avg(ev) AS expected_value, sum(ev - st) AS vss_total, sum(st - ws) AS evpi_total,
        sum(ev - st) * 8760 / sum(h) AS vss_per_year, sum(st - ws) * 8760 / sum(h) AS evpi_per_year, count(CASE WHEN ev - st > 1 THEN 1 END) AS positive_vss, count(CASE WHEN substr(a, 1, 1) <> b THEN 1 END) AS decision_differed FROM c GROUP BY 1""")
def _(t):
    orders = t.t("orders").join(t.t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(
        t.places, F.col("c_nationkey") == F.col("n_nationkey"))
    price, extra = F.col("o_totalprice"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 50).otherwise(0)
    costs = orders.select(F.col("r_name").alias("region"), F.lit(72).alias("horizon_h"), price.alias("wait_and_see_cost"), (price * 1.1).alias("stochastic_cost"),
                          (price * 1.1 + extra).alias("expected_value_cost"), F.substring("o_orderpriority", 1, 1).alias("committed_action"), F.col("o_orderstatus").alias("deterministic_action"))
    return planning.policy_summary(costs)


@query("describe_readings", "E41", "region n:i mean:f std:f min:f q25:f q50:f q75:f max:f", """
    SELECT region, count(demand_mw) AS n, avg(demand_mw) AS mean, stddev_samp(demand_mw) AS std, min(demand_mw) AS min, quantile_cont(demand_mw, 0.25) AS q25, quantile_cont(demand_mw, 0.5) AS q50, quantile_cont(demand_mw, 0.75) AS q75, max(demand_mw) AS max FROM x_market GROUP BY 1""")
def _(t):
    return fitting.describe(t.market, ["region"], "demand_mw")


@query("window_kpis", "E42", "region surplus_hours:i shortage_hours:i surplus_mwh:f shortage_mwh:f held_share:f peak_surplus_hour:t peak_hour:t", """
    WITH m AS (SELECT *, least(coalesce(solar_uigf_mw, 0) / 50, 1) AS p_surplus, least(demand_mw / 100, 1) AS p_shortage FROM x_market)
    SELECT m.region, count(CASE WHEN p_surplus >= 0.5 THEN 1 END) AS surplus_hours, count(CASE WHEN p_shortage >= 0.5 THEN 1 END) AS shortage_hours, sum(solar_uigf_mw) AS surplus_mwh, sum(wind_uigf_mw) AS shortage_mwh,
      avg(CAST(wind_uigf_mw BETWEEN 5 AND 20 AS INTEGER)) AS held_share, max(a.t) AS peak_surplus_hour, max(b.t) AS peak_hour FROM m
    JOIN (SELECT region, valid_time AS t, row_number() OVER (PARTITION BY region ORDER BY round(p_surplus, 9) DESC, valid_time) AS r FROM m) a ON a.region = m.region AND a.r = 1
    JOIN (SELECT region, valid_time AS t, row_number() OVER (PARTITION BY region ORDER BY round(demand_mw, 6) DESC, valid_time) AS r FROM m) b ON b.region = m.region AND b.r = 1 GROUP BY 1""")
def _(t):
    points = t.market.withColumns({"p_surplus": F.least(F.coalesce("solar_uigf_mw", F.lit(0.0)) / 50, F.lit(1.0)), "p_shortage": F.least(F.col("demand_mw") / 100, F.lit(1.0)),
                                   "expected_surplus_mw": F.col("solar_uigf_mw"), "expected_shortage_mw": F.col("wind_uigf_mw"), "demand_p50_mw": F.col("demand_mw"),
                                   "actual_renewable_mw": F.col("wind_uigf_mw"), "renewable_p10_mw": F.lit(5.0), "renewable_p90_mw": F.lit(20.0)})
    return metrics.band_kpis(points, ["region"])


@query("typical_day_storage", "E43", "region storage_mwh:f recurring_hours:i recurring_mwh:f", f"""
    {_GRID_SQL}, d AS (SELECT region, month, greatest(-mean_residual_mw, 0) AS s, greatest(mean_residual_mw, 0) AS f, CASE WHEN month = 2 THEN 28 WHEN month IN (4, 6, 9, 11) THEN 30 ELSE 31 END AS days FROM g),
    m AS (SELECT region, month, days, sum(s) AS s, sum(f) AS f, count(CASE WHEN s > 0 THEN 1 END) AS h FROM d GROUP BY ALL)
    SELECT region, max(CASE WHEN f > 0 THEN least(s, f) ELSE s END) AS storage_mwh, sum(h * days) AS recurring_hours, sum(s * days) AS recurring_mwh FROM m GROUP BY 1""")
def _(t):
    grid = seasonal.month_hour_grids(seasonal.local_balance(t.history, REGION_CLOCKS))
    return seasonal.typical_day_storage(seasonal.surplus_positive_view(grid))


@query("width_by_lead", "E44", "tech lead_bucket mean_width:f rises:b", f"""
    SELECT *, coalesce(mean_width >= lag(mean_width) OVER (PARTITION BY tech ORDER BY lead_bucket), true) AS rises FROM (
      SELECT tech, {_BUCKET_SQL} AS lead_bucket, avg((p90_mw - p10_mw) / capacity_mw) AS mean_width FROM x_eval GROUP BY ALL)""")
def _(t):
    return fitting.widths_rise(t.eval, ["tech"])


@query("lead_bucket_counts", "C9 E38", "lead_bucket n:i percent:f", f"SELECT {_BUCKET_SQL} AS lead_bucket, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM x_eval GROUP BY 1")
def _(t):
    from gridloom.operators.splits import share_summary

    return share_summary(t.eval.withColumn("lead_bucket", clock.lead_bucket(F.col("horizon_h"))), "lead_bucket")
