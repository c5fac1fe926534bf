"""Catalogue: contracts, validation and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import contracts
from gridloom.plans.registry import query


@query("conform_power", "B1", "site_id valid_time_utc:t tech power_mw:f is_valid:b", """
    SELECT site_id, valid_time AS valid_time_utc, tech, CAST(CAST(round(power_mw * 8) / 8 AS FLOAT) AS DOUBLE) AS power_mw, power_mw IS NOT NULL AS is_valid
    FROM x_grid""")
def _(t):
    eighths = F.round(F.col("power_mw") * 8) / 8
    raw = t.grid.select(
        F.lit("1.0").alias("capacity_mw"), F.col("power_mw").isNotNull().alias("is_valid"), "tech",
        F.date_format("valid_time", "yyyy-MM-dd HH:mm:ss").alias("valid_time_utc"),
        F.coalesce(eighths.cast("string"), F.lit("NaN")).alias("power_mw"), "site_id",
    )
    return contracts.conform(raw, contracts.POWER)


@query("duplicate_keys", "B1", "user_id:i hour:t n:i",
       "SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def _(t):
    keyed = t.events.select("user_id", F.date_trunc("hour", "ts").alias("hour"))
    return contracts.duplicate_keys(keyed, ("user_id", "hour"))


@query("weather_rules", "B2", "rule violations:i", """
    SELECT 'negative_horizon' AS rule, count(CASE WHEN horizon_h < 0 THEN 1 END) AS violations FROM x_weather
    UNION ALL SELECT 'horizon_mismatch', count(CASE WHEN hour(valid_time) = 5 THEN 1 END) FROM x_weather
    UNION ALL SELECT 'ghi_wm2_range', count(CASE WHEN ghi_wm2 * 2 < -1 OR ghi_wm2 * 2 > 1400 THEN 1 END) FROM x_weather
    UNION ALL SELECT 'wind_speed_10m_range', count(CASE WHEN wind_speed_10m * 20 > 90 THEN 1 END) FROM x_weather""")
def _(t):
    wrong = t.weather.withColumns({
        "horizon_h": F.when(F.hour("valid_time") == 5, 99).otherwise(F.col("horizon_h")),
        "ghi_wm2": F.col("ghi_wm2") * 2, "wind_speed_10m": F.col("wind_speed_10m") * 20,
    })
    rules = contracts.weather_rules("issue_time", "valid_time", ["ghi_wm2", "wind_speed_10m"])
    return contracts.rule_counts(wrong, rules)


@query("power_rules", "B3", "rule violations:i", """
    SELECT 'unknown_tech' AS rule, count(CASE WHEN user_id % 3 = 2 THEN 1 END) AS violations FROM events
    UNION ALL SELECT 'nonpositive_capacity', count(CASE WHEN value - 1 <= 0 THEN 1 END) FROM events
    UNION ALL SELECT 'negative_power', count(CASE WHEN user_id % 2 = 0 AND 5 - value < (value - 1) * -0.01 THEN 1 END) FROM events""")
def _(t):
    rows = t.events.select(
        F.when(F.col("user_id") % 3 == 0, "solar").when(F.col("user_id") % 3 == 1, "wind").otherwise("tidal").alias("tech"),
        (F.col("value") - 1).alias("capacity_mw"), (5 - F.col("value")).alias("power_mw"), (F.col("user_id") % 2 == 0).alias("is_valid"),
    )
    return contracts.rule_counts(rows, contracts.power_rules())


@query("column_presence", "B4", "column filled:i present:b", """
    SELECT 'cloud_low' AS "column", count(cloud_low) AS filled, true AS present FROM x_weather
    UNION ALL SELECT 'ghi_wm2', count(ghi_wm2), true FROM x_weather
    UNION ALL SELECT 'precip_mm', 0, false""")
def _(t):
    return contracts.column_presence(t.weather, ["cloud_low", "ghi_wm2", "precip_mm"])


@query("market_audit", "B5", "check value:f passed:b", """
    WITH m AS (SELECT min(demand_mw) a, max(demand_mw) b, min(rrp_aud_mwh) c, max(rrp_aud_mwh) d, avg(CAST(demand_mw < 0 AS INTEGER)) e FROM x_market)
    SELECT 'duplicate_keys' AS "check", 0.0 AS value, true AS passed
    UNION ALL SELECT 'demand_min', a, a BETWEEN -1000 AND 20000 FROM m UNION ALL SELECT 'demand_max', b, b BETWEEN -1000 AND 20000 FROM m
    UNION ALL SELECT 'price_min', c, c BETWEEN -1000 AND 20000 FROM m UNION ALL SELECT 'price_max', d, d BETWEEN -1000 AND 20000 FROM m
    UNION ALL SELECT 'negative_demand_share', e, e <= 0.01 FROM m""")
def _(t):
    return contracts.market_audit(t.market)


@query("band_order", "B6", "event_id:i p10_mw:f p50_mw:f p90_mw:f", """
    SELECT event_id, value AS p10_mw, CAST(user_id % 20 AS DOUBLE) AS p50_mw, value * 2 AS p90_mw FROM events
    WHERE NOT (value <= user_id % 20 AND user_id % 20 <= value * 2)""")
def _(t):
    points = t.events.select("event_id", F.col("value").alias("p10_mw"), (F.col("user_id") % 20).cast("double").alias("p50_mw"), (F.col("value") * 2).alias("p90_mw"))
    return contracts.band_order_violations(points)


@query("horizon_integrity", "B6", "user_id:i points:i horizons:i valid:b", """
    SELECT user_id, count(*) AS points, count(DISTINCT hour(ts)) AS horizons, count(*) = count(DISTINCT hour(ts)) AND min(hour(ts)) >= 1 AS valid
    FROM events GROUP BY user_id""")
def _(t):
    return contracts.horizon_integrity(t.events.select("user_id", F.hour("ts").alias("horizon_h")), ["user_id"])


@query("site_rules", "B7", "rule violations:i", """
    SELECT 'blank_id' AS rule, 0 AS violations UNION ALL SELECT 'latitude_range', count(CASE WHEN latitude * 3 NOT BETWEEN -90 AND 90 THEN 1 END) FROM x_sites
    UNION ALL SELECT 'longitude_range', count(CASE WHEN longitude * 1.2 > 180 THEN 1 END) FROM x_sites
    UNION ALL SELECT 'nonpositive_capacity', count(CASE WHEN capacity_mw - 40 <= 0 THEN 1 END) FROM x_sites
    UNION ALL SELECT 'speed_order', count(CASE WHEN rated_ws_ms >= 12 THEN 1 END) FROM x_sites""")
def _(t):
    wrong = t.sites.withColumns({"latitude": F.col("latitude") * 3, "longitude": F.col("longitude") * 1.2,
                                 "capacity_mw": F.col("capacity_mw") - 40, "cut_out_ws_ms": F.lit(12.0)})
    return contracts.rule_counts(wrong, contracts.site_rules())


@query("request_identifiable", "B7", "s_suppkey:i ok:b", "SELECT s_suppkey, s_suppkey % 3 = 0 OR s_suppkey % 2 = 0 AS ok FROM supplier")
def _(t):
    k = F.col("s_suppkey")
    requests = t.t("supplier").select(
        "s_suppkey", F.when(k % 3 == 0, "S1").alias("site_id"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
        F.when(k % 2 == 0, "solar").alias("tech"), F.lit(5.0).alias("capacity_mw"),
    )
    return requests.select("s_suppkey", contracts.request_is_identifiable().alias("ok"))


@query("aligned_features", "B8", "temp_2m_c:f ghi_wm2:f horizon_h:i", "SELECT temp_2m_c, ghi_wm2, horizon_h FROM x_weather")
def _(t):
    return contracts.align_features(t.weather, ["temp_2m_c", "ghi_wm2", "horizon_h"])


@query("source_comparison", "B9", "variable n:i correlation:f mean_left:f mean_right:f mae:f agrees:b", """
    WITH j AS (SELECT a.ghi_wm2 AS ga, b.ghi_wm2 * 0.9 AS gb, a.temp_2m_c AS ta, b.temp_2m_c AS tb, a.cloud_low AS ca, b.wind_dir_10m_deg AS cb
        FROM x_weather a JOIN x_weather b ON a.site_id = b.site_id AND a.valid_time = b.valid_time WHERE a.horizon_h = 24 AND b.horizon_h = 72),
    l AS (SELECT 'ghi_wm2' AS variable, ga AS a, gb AS b FROM j UNION ALL SELECT 'temp_2m_c', ta, tb FROM j
          UNION ALL SELECT 'cloud_low', ca, cb FROM j)
    SELECT variable, count(*) AS n, corr(a, b) AS correlation, avg(a) AS mean_left, avg(b) AS mean_right, avg(abs(a - b)) AS mae, coalesce(corr(a, b) > 0.85, false) AS agrees
    FROM l WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY variable HAVING count(*) >= 100""")
def _(t):
    short, long = t.weather.where("horizon_h = 24"), t.weather.where("horizon_h = 72")
    other = long.withColumns({"ghi_wm2": F.col("ghi_wm2") * 0.9, "cloud_low": F.col("wind_dir_10m_deg")})
    return contracts.compare_sources(short, other, ["site_id", "valid_time"], ["ghi_wm2", "temp_2m_c", "cloud_low"])


@query("corpus_coverage", "B12 H2", "site_id covered:b leads", """
    SELECT s.site_id, max(l.site_id) IS NOT NULL AS covered, CASE WHEN max(l.site_id) IS NULL THEN '' ELSE '24,48,72' END AS leads
    FROM x_sites s LEFT JOIN (SELECT DISTINCT site_id FROM x_leads) l ON s.site_id = l.site_id GROUP BY s.site_id""")
def _(t):
    return contracts.corpus_coverage(t.sites, t.leads)
