"""Catalogue: window functions, runs, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import calibration, features, joins, metrics, runs, seasonal
from gridloom.operators.resample import fill
from gridloom.plans.adapters import REGION_CLOCKS
from gridloom.plans.registry import query

_W = "OVER (PARTITION BY site_id, horizon_h ORDER BY valid_time"


@query("neighbour_features", "F2 F3 F4 G1", "site_id valid_time:t horizon_h:i ghi_wm2_lag3:f ghi_wm2_lag1:f ghi_wm2_lead1:f ghi_wm2_lead3:f ghi_wm2_roll_mean:f ghi_wm2_roll_std:f ghi_wm2_delta:f", f"""
    SELECT site_id, valid_time, horizon_h, lag(ghi_wm2, 3) {_W}) AS ghi_wm2_lag3, lag(ghi_wm2, 1) {_W}) AS ghi_wm2_lag1, lead(ghi_wm2, 1) {_W}) AS ghi_wm2_lead1, lead(ghi_wm2, 3) {_W}) AS ghi_wm2_lead3,
        avg(ghi_wm2) {_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ghi_wm2_roll_mean, coalesce(stddev_samp(ghi_wm2) {_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) AS ghi_wm2_roll_std,
        ghi_wm2 - lag(ghi_wm2) {_W}) AS ghi_wm2_delta FROM x_weather""")
def _(t):
    return t.weather.select("site_id", "valid_time", "horizon_h", *features.neighbours("ghi_wm2", features.per_lead()))


@query("turbulence_features", "F5", "site_id valid_time:t horizon_h:i turbulence_intensity:f ws_range_6h:f ws_lead6:f ws_lag6:f", f"""
    SELECT site_id, valid_time, horizon_h, coalesce(stddev_samp(wind_speed_100m) {_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / greatest(avg(wind_speed_100m) {_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0.5), 0) AS turbulence_intensity,
        coalesce(max(wind_speed_100m) {_W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - min(wind_speed_100m) {_W} ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 0) AS ws_range_6h,
        lead(wind_speed_100m, 6) {_W}) AS ws_lead6, lag(wind_speed_100m, 6) {_W}) AS ws_lag6 FROM x_weather""")
def _(t):
    return t.weather.select("site_id", "valid_time", "horizon_h", *features.turbulence("wind_speed_100m", features.per_lead()))


@query("load_history", "F7 F8", "region valid_time:t load_lag_24h:f load_mean_168h:f load_std_24h:f load_std_168h:f rooftop_lag_24h:f", """
    SELECT region, valid_time, lag(demand_mw, 24) OVER o AS load_lag_24h, CASE WHEN count(demand_mw) OVER b >= 42 THEN avg(demand_mw) OVER b END AS load_mean_168h,
        stddev_samp(demand_mw) OVER a AS load_std_24h, stddev_samp(demand_mw) OVER b AS load_std_168h, lag(rooftop_pv_mw, 24) OVER o AS rooftop_lag_24h FROM x_market_grid
    WINDOW o AS (PARTITION BY region ORDER BY valid_time), a AS (PARTITION BY region ORDER BY valid_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), b AS (PARTITION BY region ORDER BY valid_time ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)""")
def _(t):
    return features.load_history(t.market_grid)


@query("template_blocks", "F10", "region block_start:t complete:i sites:i", """
    WITH st AS (SELECT region, valid_time, lead(valid_time, 23) OVER (PARTITION BY region ORDER BY valid_time) AS e FROM (SELECT DISTINCT region, valid_time FROM x_residuals)),
    cs AS (SELECT region, site_id, valid_time, lead(valid_time, 23) OVER (PARTITION BY site_id ORDER BY valid_time) AS e FROM (SELECT * FROM x_residuals WHERE NOT (site_id = 'S3' AND hour(valid_time) = 7)))
    SELECT st.region, st.valid_time AS block_start, count(*) AS complete, max(n.n) AS sites FROM st JOIN cs ON cs.region = st.region AND cs.valid_time = st.valid_time AND cs.e = cs.valid_time + INTERVAL 23 HOUR
    JOIN (SELECT region, count(DISTINCT site_id) AS n FROM x_residuals GROUP BY 1) n ON n.region = st.region WHERE st.e = st.valid_time + INTERVAL 23 HOUR AND hour(st.valid_time) = 6
    GROUP BY st.region, st.valid_time HAVING count(*) >= 0.8 * max(n.n)""")
def _(t):
    holed = t.residuals.withColumn("residual", F.when(~((F.col("site_id") == "S3") & (F.hour("valid_time") == 7)), F.col("residual")))
    return runs.template_starts(holed, 24, start_hour=6)


_RUN_SQL = """
    SELECT region, {label} min(valid_time) AS from_utc, max(valid_time) AS to_utc, count(*) AS hours, max(p) AS peak_probability, sum(e) AS energy_mwh FROM (
      SELECT *, sum(n) OVER (PARTITION BY region ORDER BY valid_time) AS run FROM (
        SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY region ORDER BY valid_time) AND lag(valid_time) OVER (PARTITION BY region ORDER BY valid_time) = valid_time - INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM (
          SELECT region, valid_time, demand_mw / 100 AS p, coalesce(wind_uigf_mw, 0) AS e, demand_mw / 100 >= 0.3 AS f FROM x_market)))
    WHERE f GROUP BY region, run HAVING count(*) >= 2"""


@query("event_runs", "F11 G5", "region kind from_utc:t to_utc:t hours:i peak_probability:f energy_mwh:f", _RUN_SQL.format(label="'shortage' AS kind,"))
def _(t):
    points = t.market.select("region", "valid_time", (F.col("demand_mw") / 100).alias("p_shortage"), F.coalesce("wind_uigf_mw", F.lit(0.0)).alias("expected_shortage_mw"))
    return runs.event_runs(points, "shortage", threshold=0.3)


_DROUGHT = """
    WITH d AS (SELECT *, renewable_mwh / demand_mwh AS share, renewable_mwh / demand_mwh < 0.2 AS f FROM x_daily WHERE demand_mwh > 0),
    r AS (SELECT region, min(date) AS starts, max(date) AS ends, count(*) AS length, sum(renewable_mwh) AS r, sum(demand_mwh) AS d FROM (
      SELECT *, sum(n) OVER (PARTITION BY region ORDER BY date) AS run FROM (SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY region ORDER BY date) THEN 0 ELSE 1 END AS n FROM d))
      WHERE f GROUP BY region, run HAVING count(*) >= 2)"""


@query("drought_runs", "F14", "region starts:d ends:d length:i month:i mean_share:f residual_mwh:f", f"{_DROUGHT} SELECT region, starts, ends, length, month(starts) AS month, r / d AS mean_share, d - r AS residual_mwh FROM r")
def _(t):
    return seasonal.drought_runs(seasonal.with_daily_share(t.daily))


@query("drought_summary", "F14", "region count:i per_year:f days_per_year:f p50:f p90:f longest:i longest_from:d", f"""
    {_DROUGHT} SELECT y.region, coalesce(c, 0) AS count, coalesce(c, 0) / y.y AS per_year, coalesce(s, 0) / y.y AS days_per_year, p50, p90, longest, longest_from
    FROM (SELECT region, date_diff('day', min(date), max(date)) / 365.25 AS y FROM x_daily GROUP BY 1) y
    LEFT JOIN (SELECT region, count(*) AS c, sum(length) AS s, quantile_cont(length, 0.5) AS p50, quantile_cont(length, 0.9) AS p90, max(length) AS longest FROM r GROUP BY 1) a ON a.region = y.region
    LEFT JOIN (SELECT region, starts AS longest_from FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY length DESC, starts) AS k FROM r) WHERE k = 1) b ON b.region = y.region""")
def _(t):
    days = seasonal.with_daily_share(t.daily)
    return seasonal.drought_summary(days, seasonal.drought_runs(days))


@query("worst_droughts", "F14 G2", "region rank:i starts:d length:i", f"""
    {_DROUGHT} SELECT region, k AS rank, starts, length FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY length DESC, starts) AS k FROM r) WHERE k <= 5""")
def _(t):
    return runs.longest_runs(seasonal.drought_runs(seasonal.with_daily_share(t.daily)), ["region"], n=5)


@query("droughts_by_month", "F14", "region month:i n:i", f"{_DROUGHT} SELECT region, month(starts) AS month, count(*) AS n FROM r GROUP BY ALL")
def _(t):
    return seasonal.droughts_by_month(seasonal.drought_runs(seasonal.with_daily_share(t.daily)))


@query("longest_state_runs", "F15", "site_id state starts:t ends:t length:i", """
    WITH s AS (SELECT site_id, valid_time, CASE WHEN coalesce(power_mw, 0) >= 8 THEN 'surplus' ELSE 'shortage' END AS state FROM x_grid),
    r AS (SELECT site_id, state, min(valid_time) AS starts, max(valid_time) AS ends, count(*) AS length FROM (
      SELECT *, sum(n) OVER (PARTITION BY site_id ORDER BY valid_time) AS run FROM (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY site_id ORDER BY valid_time) THEN 0 ELSE 1 END AS n FROM s)) GROUP BY site_id, state, run)
    SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY site_id, state ORDER BY length DESC, starts) AS k FROM r) WHERE k = 1""")
def _(t):
    state = F.when(F.coalesce("power_mw", F.lit(0.0)) >= 8, "surplus").otherwise("shortage")
    return runs.longest_runs(runs.state_runs(t.grid, ["site_id"], "valid_time", state, []), ["site_id", "state"])


@query("operating_signals", "F16", "site_id horizon_h:i hours:i near_rated:i max_ramp:f ramp_at:t at_ceiling:i widest_band:f widest_at:t", """
    WITH e AS (SELECT *, abs(p50_mw - lag(p50_mw) OVER (PARTITION BY site_id, horizon_h ORDER BY valid_time)) AS ramp, p90_mw - p10_mw AS width FROM x_eval)
    SELECT e.site_id, e.horizon_h, count(*) AS hours, count(CASE WHEN p50_mw >= 0.9 * greatest(capacity_mw, 1) THEN 1 END) AS near_rated, max(ramp) AS max_ramp, max(a.t) AS ramp_at,
        count(CASE WHEN actual_mw > 0 AND p50_mw >= 0.98 * least(actual_mw, capacity_mw) THEN 1 END) AS at_ceiling, max(width) AS widest_band, max(b.t) AS widest_at FROM e
    JOIN (SELECT site_id, horizon_h, valid_time AS t, row_number() OVER (PARTITION BY site_id, horizon_h ORDER BY round(ramp, 6) DESC NULLS LAST, valid_time) AS k FROM e) a ON a.site_id = e.site_id AND a.horizon_h = e.horizon_h AND a.k = 1
    JOIN (SELECT site_id, horizon_h, valid_time AS t, row_number() OVER (PARTITION BY site_id, horizon_h ORDER BY round(width, 6) DESC, valid_time) AS k FROM e) b ON b.site_id = e.site_id AND b.horizon_h = e.horizon_h AND b.k = 1 GROUP BY 1, 2""")
def _(t):
    points = t.eval.withColumn("clearsky_mw", F.col("actual_mw"))
    return runs.operating_signals(points, ["site_id", "horizon_h"])


@query("quietest_window", "F17", "site_id starts:t ends:t total:f", """
    WITH s AS (SELECT site_id, valid_time, sum(v) OVER w AS total, max(valid_time) OVER w AS ends, count(*) OVER w AS n FROM (SELECT site_id, valid_time, coalesce(power_mw, 0) + CAST(hour(valid_time) AS DOUBLE) / 7 AS v FROM x_grid)
        WINDOW w AS (PARTITION BY site_id ORDER BY valid_time ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
    SELECT site_id, valid_time AS starts, ends, total FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(total, 6), valid_time) AS k FROM s WHERE n = 4) WHERE k = 1""")
def _(t):
    points = t.grid.select("site_id", "valid_time", (F.coalesce("power_mw", F.lit(0.0)) + F.hour("valid_time") / 7.0).alias("v"))
    return runs.quietest_window(points, ["site_id"], "valid_time", "v")


@query("running_maximum", "F18", "site_id valid_time:t power_mw:f", """
    SELECT site_id, valid_time, max(power_mw) OVER (PARTITION BY site_id ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS power_mw FROM x_grid""")
def _(t):
    return calibration.running_maximum(t.grid, ["site_id"], "valid_time", "power_mw")


@query("persistence_baselines", "F19 D7", "site_id valid_time:t horizon_h:i persistence:f smart:f", """
    SELECT e.site_id, e.valid_time, e.horizon_h, coalesce(h.power_mw, 0) AS persistence, CASE WHEN e.tech = 'wind' THEN coalesce(h.power_mw, 0)
        ELSE least(CASE WHEN c0 > 0.000001 THEN coalesce(h.power_mw, 0) / c0 ELSE 0 END, 1.3) * c END AS smart
    FROM (SELECT *, CAST(hour(valid_time) AS DOUBLE) AS c, CASE WHEN h0 THEN CAST(hour(issue_time) AS DOUBLE) ELSE 0 END AS c0 FROM (
        SELECT e.*, g.site_id IS NOT NULL AS h0 FROM x_eval e LEFT JOIN x_grid g ON g.site_id = e.site_id AND g.valid_time = e.issue_time)) e
    LEFT JOIN x_hourly h ON h.site_id = e.site_id AND h.valid_time = e.issue_time""")
def _(t):
    measured = t.grid.withColumn("clear", F.hour("valid_time").cast("double"))
    rows = joins.value_at_issue(t.eval.withColumn("clearsky_mw", F.hour("valid_time").cast("double")), measured,
                                {"power_mw": "power_at_issue_mw", "clear": "clear_at_issue_mw"}, ["valid_time"])
    smart = metrics.smart_persistence(F.col("power_at_issue_mw"), F.col("clear_at_issue_mw"), F.col("clearsky_mw"), F.col("tech"))
    return rows.select("site_id", "valid_time", "horizon_h", F.col("power_at_issue_mw").alias("persistence"), smart.alias("smart"))


@query("seasonal_naive", "F20", "region valid_time:t demand_mw:f naive_mw:f", """
    SELECT a.region, a.valid_time, a.demand_mw, b.demand_mw AS naive_mw FROM x_market a LEFT JOIN x_market b ON b.region = a.region AND b.valid_time = a.valid_time - INTERVAL 168 HOUR""")
def _(t):
    from gridloom.plans.training import seasonal_naive

    return seasonal_naive(t.market.select("region", "valid_time", "demand_mw"))


@query("filled_series", "F21", "site_id valid_time:t power_mw:f", """
    SELECT site_id, valid_time, coalesce(last_value(power_mw IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY valid_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(power_mw IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY valid_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS power_mw FROM x_grid""")
def _(t):
    return t.grid.select("site_id", "valid_time", fill("power_mw", ["site_id"], "valid_time").alias("power_mw"))


@query("argmax_record", "G4", "region month:i surplus_mwh:f", """
    SELECT region, month, s AS surplus_mwh FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY s DESC) AS k FROM (SELECT region, month, sum(surplus_mw) AS s FROM x_balance GROUP BY region, month)) WHERE k = 1""")
def _(t):
    months = seasonal.local_balance(t.history, REGION_CLOCKS).groupBy("region", "month").agg(F.sum("surplus_mw").alias("s"))
    return months.groupBy("region").agg(F.max_by("month", "s").alias("month"), F.max("s").alias("surplus_mwh"))


@query("most_common_lead", "G6", "user_id:i event_id:i horizon_h:i", """
    WITH c AS (SELECT user_id, event_id % 4 AS h, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT user_id, h FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, h) AS k FROM c) WHERE k = 1)
    SELECT e.user_id, e.event_id, b.h AS horizon_h FROM events e JOIN b ON b.user_id = e.user_id AND b.h = e.event_id % 4""")
def _(t):
    rows = t.events.select("user_id", "event_id", (F.col("event_id") % 4).alias("horizon_h"))
    return joins.most_common_lead(rows, ["user_id"])


@query("first_alerts", "G7", "event_id:i value:f", "SELECT event_id, value FROM events WHERE value > 30 ORDER BY ts, event_id LIMIT 3")
def _(t):
    return joins.ordered_head(t.events.where("value > 30"), ["ts", "event_id"], 3)


@query("top_features", "G2", "site_id rank:i valid_time:t power_mw:f", """
    SELECT site_id, k AS rank, valid_time, power_mw FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY power_mw DESC, valid_time) AS k FROM x_hourly) WHERE k <= 20""")
def _(t):
    return joins.rank_within(t.hourly, ["site_id"], [F.col("power_mw").desc(), F.col("valid_time")], 20)
