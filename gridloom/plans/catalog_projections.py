"""Catalogue: projections, filters and physics columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import bands, clock, solar, weather, wind
from gridloom.operators import features, seasonal
from gridloom.plans.adapters import REGION_CLOCKS
from gridloom.plans.registry import query
from gridloom.plans.solar_sql import SOLAR_ESTIMATE
from gridloom.sources import market, payloads, tables


@query("market_clock", "C1", "event_id:i utc:t", """
    SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE date_trunc('second', ts) - INTERVAL 10 HOUR - INTERVAL 5 MINUTE END AS utc FROM events""")
def _(t):
    stamp = F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.date_format("ts", clock.MARKET_STAMP))
    return t.events.select("event_id", clock.market_to_utc(stamp, 5).alias("utc"))


@query("run_columns", "C2", "event_id:i issue:t horizon_h:i", """
    SELECT event_id, date_trunc('day', ts - INTERVAL 1 HOUR) AS issue,
           CAST(round((epoch(ts) - epoch(date_trunc('day', ts - INTERVAL 1 HOUR))) / 3600) AS BIGINT) AS horizon_h FROM events""")
def _(t):
    issue = clock.run_issue(F.col("ts"))
    return t.events.select("event_id", issue.alias("issue"), clock.hours_between(F.col("ts"), issue).alias("horizon_h"))


@query("wind_vectors", "C4 C16", "event_id:i speed:f direction:f d_sin:f d_cos:f", """
    SELECT event_id, sqrt(u * u + v * v) AS speed, d AS direction, sin(radians(d)) AS d_sin, cos(radians(d)) AS d_cos
    FROM (SELECT *, (270 - degrees(atan2(v, u)) + 360) % 360 AS d FROM
      (SELECT event_id, value - 10 AS u, CAST(user_id % 17 - 8 AS DOUBLE) + 0.5 AS v FROM events))""")
def _(t):
    u, v = F.col("value") - 10, (F.col("user_id") % 17 - 8).cast("double") + 0.5
    d = weather.wind_direction(u, v)
    return t.events.select("event_id", weather.wind_speed(u, v).alias("speed"), d.alias("direction"), *weather.direction_components(d, "d"))


@query("clip_and_presence", "C5 C6", "site_id valid_time:t horizon_h:i pressure_hpa:f cloud_low:f", """
    SELECT site_id, valid_time, horizon_h, greatest(pressure_hpa - 1010, 0) AS pressure_hpa, cloud_low FROM x_weather WHERE pressure_hpa IS NOT NULL OR cloud_low IS NOT NULL""")
def _(t):
    shifted = t.weather.withColumn("pressure_hpa", F.col("pressure_hpa") - 1010).where(weather.any_present(["pressure_hpa", "cloud_low"]))
    return weather.clip_nonnegative(shifted, ["pressure_hpa"])


@query("horizon_filter", "C7", "site_id valid_time:t horizon_h:i", "SELECT site_id, valid_time, horizon_h FROM x_leads WHERE horizon_h BETWEEN 1 AND 48")
def _(t):
    return t.leads.where(F.col("horizon_h").between(1, 48))


@query("grid_cells", "C8", "site_id lat_cell:i lon_cell:i row_index:i", """
    SELECT site_id, CAST(round(latitude * 10 + 0.3) AS BIGINT) AS lat_cell, CAST(round(longitude * 10) AS BIGINT) AS lon_cell,
           greatest(0, least(99, CAST(round((latitude + 35.1) / 0.5) AS BIGINT))) AS row_index FROM x_sites""")
def _(t):
    return t.sites.select(
        "site_id", weather.grid_cell(F.col("latitude") + 0.03, 0.1).alias("lat_cell"), weather.grid_cell(F.col("longitude"), 0.1).alias("lon_cell"),
        weather.array_index(F.col("latitude"), -35.1, 0.5, 100).alias("row_index"),
    )


@query("lead_buckets", "C9", "user_id:i bucket n:i", """
    SELECT user_id, CASE WHEN user_id % 80 BETWEEN 1 AND 24 THEN '1-24h' WHEN user_id % 80 BETWEEN 25 AND 48 THEN '25-48h'
        WHEN user_id % 80 BETWEEN 49 AND 72 THEN '49-72h' ELSE 'out-of-range' END AS bucket, count(*) AS n FROM events GROUP BY user_id""")
def _(t):
    return t.events.groupBy("user_id", clock.lead_bucket(F.col("user_id") % 80).alias("bucket")).agg(F.count("*").alias("n"))


@query("archive_chunks", "C10", "event_id:i first:i last:i starts:t", """
    SELECT event_id, CAST(floor((h + 312) / 253) AS BIGINT) AS first, CAST(ceil((h + 312) / 253) AS BIGINT) AS last,
           TIMESTAMP '1970-01-01' + to_hours(CAST(floor((h + 312) / 253) * 253 - 312 AS INTEGER)) AS starts
    FROM (SELECT event_id, floor(epoch(ts)) / CAST(3600 AS DOUBLE) AS h FROM events)""")
def _(t):
    first = clock.chunk_index(F.col("ts"))
    return t.events.select("event_id", first.alias("first"), clock.chunk_last_index(F.col("ts")).alias("last"), clock.chunk_start(first).alias("starts"))


@query("hub_interpolation", "C11", "event_id:i speed:f ghi:f", """
    SELECT event_id, coalesce(lo * (1 - w) + hi * w, hi, lo) AS speed, coalesce(value + hi, value, hi) AS ghi
    FROM (SELECT event_id, value, CASE WHEN user_id % 3 <> 0 THEN value END AS lo, CASE WHEN user_id % 4 <> 0 THEN value * 1.2 END AS hi,
          (ln(CAST(100 AS DOUBLE)) - ln(CAST(80 AS DOUBLE))) / (ln(CAST(120 AS DOUBLE)) - ln(CAST(80 AS DOUBLE))) AS w FROM events)""")
def _(t):
    lo, hi = F.when(F.col("user_id") % 3 != 0, F.col("value")), F.when(F.col("user_id") % 4 != 0, F.col("value") * 1.2)
    return t.events.select("event_id", weather.log_height_speed(lo, hi, 80, 120, 100).alias("speed"), weather.global_irradiance(F.col("value"), hi).alias("ghi"))


@query("calendar_features", "C12", "event_id:i hour_sin:f hour_cos:f doy_sin:f doy_cos:f dow_sin:f dow_cos:f is_weekend:f lead_day:i", """
    SELECT event_id, sin(p * hour(ts) / 24) AS hour_sin, cos(p * hour(ts) / 24) AS hour_cos, sin(p * dayofyear(ts) / 365.25) AS doy_sin,
           cos(p * dayofyear(ts) / 365.25) AS doy_cos, sin(p * (isodow(ts) - 1) / 7) AS dow_sin, cos(p * (isodow(ts) - 1) / 7) AS dow_cos,
           CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend, ceil((user_id % 72 + 1) / 24.0) AS lead_day
    FROM (SELECT *, 2 * CAST(pi() AS DOUBLE) AS p FROM events)""")
def _(t):
    return t.events.select("event_id", *clock.calendar_features(F.col("ts")), clock.lead_day(F.col("user_id") % 72 + 1).alias("lead_day"))


@query("public_holidays", "C13", "date:d is_holiday:f", """
    WITH y AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders),
    a AS (SELECT date, year(date) AS yr, year(date) % 19 AS g, year(date) // 100 AS c FROM y),
    b AS (SELECT *, (c - c // 4 - (8 * c + 13) // 25 + 19 * g + 15) % 30 AS h FROM a),
    d AS (SELECT *, h - (h // 28) * (1 - (h // 28) * (29 // (h + 1)) * ((21 - g) // 11)) AS i FROM b),
    e AS (SELECT *, i - (yr + yr // 4 + i + 2 - c + c // 4) % 7 AS l FROM d),
    f AS (SELECT *, make_date(yr, 3 + (l + 40) // 44, l + 28 - 31 * ((3 + (l + 40) // 44) // 4)) AS easter FROM e)
    SELECT date, CASE WHEN strftime(date, '%m-%d') IN ('01-01', '01-26', '04-25', '12-25', '12-26') OR date = easter - 2 OR date = easter + 1 THEN 1 ELSE 0 END AS is_holiday FROM f""")
def _(t):
    dates = t.t("orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return dates.select("date", clock.is_public_holiday(F.col("date")).alias("is_holiday"))


@query("degree_days", "C14", "site_id valid_time:t horizon_h:i cooling:f heating:f", """
    SELECT site_id, valid_time, horizon_h, greatest(temp_2m_c - 18, 0) AS cooling, greatest(18 - temp_2m_c, 0) AS heating FROM x_weather""")
def _(t):
    temp = F.col("temp_2m_c")
    return t.weather.select("site_id", "valid_time", "horizon_h", weather.cooling_degrees(temp).alias("cooling"), weather.heating_degrees(temp).alias("heating"))


_WIND_SQL = """
    SELECT *, CASE WHEN v < cut_in_ws_ms OR v > cut_out_ws_ms THEN 0 WHEN v <= rated_ws_ms THEN (v * v * v - 27) / (power(rated_ws_ms, 3) - 27) ELSE 1 END AS cf FROM (
    SELECT *, hubws * cbrt(rho / 1.225) AS v FROM (
    SELECT *, greatest(wind_speed_100m * power(hub / 100, alpha), 0) AS hubws FROM (
    SELECT w.*, s.capacity_mw, s.rated_ws_ms, s.cut_in_ws_ms, s.cut_out_ws_ms, coalesce(s.hub_height_m, CAST(100 AS DOUBLE)) AS hub,
           coalesce(s.rotor_diameter_m, CAST(90 AS DOUBLE)) AS rotor,
           least(greatest(coalesce(pressure_hpa, 1013.25) * 100 / (287.05 * (temp_2m_c + 273.15)), 0.9), 1.4) AS rho,
           least(greatest(log10(greatest(wind_speed_100m, 0.25) / greatest(wind_speed_10m, 0.25)), -0.10), 0.60) AS alpha
    FROM x_weather w JOIN x_sites s ON w.site_id = s.site_id WHERE w.tech = 'wind')))"""


@query("wind_physics", "C15", "site_id valid_time:t horizon_h:i air_density:f shear_exponent:f ws_hub:f ws_corrected:f ws_corrected_cube:f cf_powercurve:f", f"""
    SELECT site_id, valid_time, horizon_h, rho AS air_density, alpha AS shear_exponent, hubws AS ws_hub, v AS ws_corrected, v * v * v AS ws_corrected_cube, cf AS cf_powercurve FROM ({_WIND_SQL}) p""")
def _(t):
    windy = t.weather.where(F.col("tech") == "wind")
    return wind.with_physics(windy.join(t.sites.drop("tech"), "site_id"))


@query("wind_regimes", "C17", "site_id valid_time:t horizon_h:i ws_over_rated:f in_cubic_ramp:f near_cutout:f wdir_change_3h:f", f"""
    SELECT site_id, valid_time, horizon_h, v / rated_ws_ms AS ws_over_rated, CASE WHEN v > cut_in_ws_ms AND v < rated_ws_ms THEN 1 ELSE 0 END AS in_cubic_ramp,
           CASE WHEN v > 0.85 * cut_out_ws_ms THEN 1 ELSE 0 END AS near_cutout, coalesce(abs((d3 + 180 + 360) % 360 - 180), 0) AS wdir_change_3h
    FROM (SELECT *, wind_dir_100m_deg - lag(wind_dir_100m_deg, 3) OVER (PARTITION BY site_id, horizon_h ORDER BY valid_time) AS d3 FROM ({_WIND_SQL}) p) q""")
def _(t):
    return features.wind_features(t.weather.where(F.col("tech") == "wind"), t.sites)


_SUN = """
    sin(radians(latitude)) * sin(dec) + cos(radians(latitude)) * cos(dec) * cos(radians((hour(ts) + minute(ts) / 60.0 + longitude / 15
      + (9.87 * sin(2 * b) - 7.53 * cos(b) - 1.5 * sin(b)) / 60 - 12) * 15))"""
_SUN_FROM = """
    (SELECT *, radians(23.45 * sin(radians((dayofyear(ts) + 284) * 360 / 365.0))) AS dec, radians((dayofyear(ts) - 81) * 360 / 364.0) AS b FROM ({}) z)"""


@query("solar_estimate", "C18", "site_id valid_time:t horizon_h:i solar_elevation:f clearsky_ghi:f kt_nwp:f", f"""
    SELECT site_id, ts AS valid_time, horizon_h, degrees(asin(up)) AS solar_elevation, ck AS clearsky_ghi,
           CASE WHEN ck > 1 THEN least(greatest(ghi_wm2, 0) / ck, 1.5) ELSE 0 END AS kt_nwp
    FROM (SELECT *, CASE WHEN up > 0.001 THEN 1098 * up * exp(-0.057 / up) ELSE 0 END AS ck
      FROM (SELECT *, {_SUN} AS up FROM {_SUN_FROM.format("SELECT w.site_id, w.valid_time AS ts, w.horizon_h, w.ghi_wm2, s.latitude, s.longitude FROM x_weather w JOIN x_sites s ON w.site_id = s.site_id WHERE w.tech = 'solar'")} q1) q2) q3""")
def _(t):
    return features.solar_estimate(t.weather.where("tech = 'solar'"), t.sites)


@query("solar_power_estimate", "C18 C21", "site_id valid_time:t horizon_h:i poa_nwp:f cell_temp_c:f physics_cf:f clearsky_cf:f physics_over_clearsky:f", SOLAR_ESTIMATE)
def _(t):
    return features.solar_features(t.weather.where("tech = 'solar'"), t.sites)


@query("day_length", "C19", "site_id doy:i hours:f", """
    SELECT site_id, doy, 2 * degrees(acos(least(greatest(-tan(radians(latitude * 1.8)) * tan(radians(23.45 * sin(radians((284 + doy) * 360 / 365.0)))), -1), 1))) / 15 AS hours
    FROM (SELECT site_id, latitude, unnest(generate_series(1, 366)) AS doy FROM x_sites)""")
def _(t):
    days = t.sites.select("site_id", (F.col("latitude") * 1.8).alias("lat"), F.explode(F.sequence(F.lit(1), F.lit(366))).alias("doy"))
    return days.select("site_id", "doy", solar.day_length_hours(F.col("lat"), F.col("doy")).alias("hours"))


@query("site_features", "C20", "site_id site_tilt:f site_azimuth_sin:f site_azimuth_cos:f site_swept_area_m2:f site_specific_power:f", """
    SELECT site_id, coalesce(tilt_deg, 0) AS site_tilt, sin(radians(coalesce(azimuth_deg, 0))) AS site_azimuth_sin, cos(radians(coalesce(azimuth_deg, 0))) AS site_azimuth_cos,
           pi() * power(coalesce(rotor_diameter_m, 90) / 2, 2) AS site_swept_area_m2, capacity_mw * 1000000 / (pi() * power(coalesce(rotor_diameter_m, 90) / 2, 2)) AS site_specific_power FROM x_sites""")
def _(t):
    wind_cols, solar_cols = features.wind_site_columns(), features.solar_site_columns()
    return t.sites.select("site_id", *wind_cols[4:], *solar_cols[1:4])


@query("target_columns", "C21 C22", "site_id valid_time:t horizon_h:i capacity_factor:f clear_index:f over_clear:f", """
    SELECT site_id, valid_time, horizon_h, least(greatest(actual_mw / capacity_mw, 0), 1) AS capacity_factor,
           CASE WHEN p50_mw >= 0.001 THEN least(greatest(actual_mw / p50_mw, 0), 1.3) END AS clear_index,
           CASE WHEN p50_mw > 0.001 THEN actual_mw / p50_mw ELSE 0 END AS over_clear FROM x_eval""")
def _(t):
    a, c, clear = F.col("actual_mw"), F.col("capacity_mw"), F.col("p50_mw")
    return t.eval.select("site_id", "valid_time", "horizon_h", solar.capacity_factor(a, c).alias("capacity_factor"),
                         solar.clear_index(a, clear).alias("clear_index"), solar.guarded_ratio(a, clear).alias("over_clear"))


@query("denormalised_power", "C23", "site_id valid_time:t horizon_h:i mw:f", """
    SELECT site_id, valid_time, horizon_h, CASE WHEN p50_mw < 0.001 THEN 0 ELSE least(least(greatest(actual_mw / 10 * capacity_mw, 0), capacity_mw), 1.3 * p50_mw) END AS mw FROM x_eval""")
def _(t):
    mw = solar.denormalise(F.col("actual_mw") / 10, F.col("capacity_mw"), F.col("capacity_mw"), F.col("p50_mw"))
    return t.eval.select("site_id", "valid_time", "horizon_h", mw.alias("mw"))


@query("sorted_band", "C24", "event_id:i p10:f p50:f p90:f lower:f upper:f", """
    SELECT event_id, s[1] AS p10, s[2] AS p50, s[3] AS p90, least(s[1] + 1, s[2]) AS lower, greatest(s[3] - 1, s[2]) AS upper
    FROM (SELECT event_id, list_sort([value, CAST(user_id % 20 AS DOUBLE), CAST(event_id % 15 AS DOUBLE)]) AS s FROM events)""")
def _(t):
    band = t.events.select("event_id", *bands.sorted_band(F.col("value"), (F.col("user_id") % 20).cast("double"), (F.col("event_id") % 15).cast("double")))
    lower, upper = bands.keep_median_inside(F.col("p10") + 1, F.col("p50"), F.col("p90") - 1)
    return band.withColumns({"lower": lower, "upper": upper})


@query("curtailment", "C27", "region valid_time:t solar_curtailed_mw:f wind_curtailed_mw:f", """
    SELECT region, valid_time, greatest(solar_uigf_mw - solar_cleared_mw, 0) + 0 * solar_uigf_mw AS solar_curtailed_mw,
           CASE WHEN wind_uigf_mw IS NOT NULL THEN greatest(wind_uigf_mw - wind_cleared_mw, 0) END AS wind_curtailed_mw FROM x_market""")
def _(t):
    return market.with_curtailment(t.market)


@query("local_balance", "C28 U4", "region valid_time:t local_hour:i month:i date:d renewable_mw:f residual_mw:f surplus_mw:f curtailed_mw:f",
       "SELECT * FROM x_balance")
def _(t):
    return seasonal.local_balance(t.history, REGION_CLOCKS)


@query("sites_by_region", "C29", "site_id market_region tech", "SELECT site_id, market_region, tech FROM x_sites WHERE market_region = 'R1' AND tech = 'wind'")
def _(t):
    padded = t.sites.withColumn("market_region", F.concat(F.lit(" "), F.lower("market_region")))
    return tables.by_region(padded, "r1 ", "wind").withColumn("market_region", F.upper(F.trim("market_region")))


@query("region_one_hot", "C30", "region valid_time:t region_R0:f region_R3:f", "SELECT region, valid_time, CAST(region = 'R0' AS INTEGER) AS region_R0, CAST(region = 'R3' AS INTEGER) AS region_R3 FROM x_market")
def _(t):
    return t.market.select("region", "valid_time", *features.one_hot("region", ["R0", "R3"], "region_"))


@query("complete_rows", "C31", "site_id valid_time:t horizon_h:i", "SELECT site_id, valid_time, horizon_h FROM x_weather WHERE cloud_low IS NOT NULL AND pressure_hpa IS NOT NULL")
def _(t):
    return features.complete_rows(t.weather, ["cloud_low", "pressure_hpa", "ghi_wm2"])


@query("constant_columns", "C31", "column", "SELECT 'flat' AS \"column\" UNION ALL SELECT 'empty'")
def _(t):
    frame = t.weather.withColumns({"flat": F.lit(3.0), "empty": F.lit(None).cast("double")})
    return features.constant_columns(frame, ["ghi_wm2", "flat", "cloud_low", "empty"])


@query("action_labels", "C32", "event_id:i action", """
    SELECT event_id, CASE WHEN b >= 0.5 THEN 'cover_shortage' WHEN b >= 0.2 THEN 'hold_reserve' WHEN a >= 0.5 THEN 'absorb_surplus' WHEN a >= 0.2 THEN 'prepare_to_absorb' ELSE 'normal' END AS action
    FROM (SELECT event_id, (event_id % 11) / 10.0 AS a, (user_id % 7) / 10.0 AS b FROM events)""")
def _(t):
    return t.events.select("event_id", bands.action_label((F.col("event_id") % 11) / 10.0, (F.col("user_id") % 7) / 10.0).alias("action"))


@query("probability_map", "C33", "event_id:i p:f", """
    SELECT event_id, (i / 20) * (i / 20) + (((i + 1) / 20) * ((i + 1) / 20) - (i / 20) * (i / 20)) * (q * 20 - i) AS p
    FROM (SELECT event_id, q, CAST(least(floor(q * 20), 19) AS DOUBLE) AS i FROM (SELECT event_id, (event_id % 1001) / CAST(1000 AS DOUBLE) AS q FROM events))""")
def _(t):
    knots = F.array(*[F.lit((k / 20) ** 2) for k in range(21)])
    return t.events.select("event_id", bands.map_probability((F.col("event_id") % 1001) / 1000.0, knots).alias("p"))


@query("rounded_export", "C34", "event_id:i stamp mw:f share:f", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS stamp, round_even(CAST(event_id AS DOUBLE) / 8, 2) AS mw,
           round_even(CAST(user_id AS DOUBLE) / 32, 4) AS share FROM events""")
def _(t):
    return t.events.select("event_id", clock.iso_z(F.col("ts")).alias("stamp"), F.bround(F.col("event_id") / 8.0, 2).alias("mw"),
                           F.bround(F.col("user_id") / 32.0, 4).alias("share"))


@query("coverage_caveat", "C35", "site_id caveat", """
    SELECT site_id, CASE WHEN avg(CAST(actual_mw <= 12 AS INTEGER)) < 0.72 OR avg(CAST(actual_mw <= 12 AS INTEGER)) > 0.90 THEN 'coverage outside tolerance' ELSE 'ok' END AS caveat FROM x_eval GROUP BY site_id""")
def _(t):
    covered = t.eval.groupBy("site_id").agg(F.avg((F.col("actual_mw") <= 12).cast("double")).alias("c"))
    return covered.select("site_id", bands.coverage_caveat(F.col("c")).alias("caveat"))


@query("seasonal_view", "C37", "region month:i hour:i residual_mwh:f surplus_share:f", """
    SELECT region, month - 1 AS month, local_hour AS hour, -avg(residual_mw) AS residual_mwh, avg(CAST(surplus_mw > 0 AS INTEGER)) AS surplus_share FROM x_balance GROUP BY ALL""")
def _(t):
    block = seasonal.local_balance(t.history, REGION_CLOCKS)
    return seasonal.surplus_positive_view(seasonal.month_hour_grids(block))


@query("probable_hours", "C38", "event_id:i p:f", "SELECT event_id, (event_id % 11) / 10.0 AS p FROM events WHERE (event_id % 11) / 10.0 >= 0.5")
def _(t):
    return seasonal.hours_over(t.events.select("event_id", ((F.col("event_id") % 11) / 10.0).alias("p")), "p", 0.5)


@query("parallel_points", "C39", "l_orderkey:i horizon_h:i q:f p:f", """
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) AS horizon_h, l_quantity AS q, l_extendedprice AS p FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) <= 3""")
def _(t):
    # An order holds a handful of lines, so its arrays are payload-sized.
    lines = t.t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_extendedprice"))).alias("b"))
    arrays = lines.select("l_orderkey", F.col("b.l_quantity").alias("q"), F.col("b.l_extendedprice").alias("p"))
    return payloads.parallel_points(arrays, ["l_orderkey"], ["q", "p"], 3)
