"""Catalogue: scans, sources and sinks over text, JSON and tables derived from the driver's data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.plans.registry import query
from gridloom.session import keep_until_end, shared_dir
from gridloom.sources import hourly_json, market, meter, payloads, stations, tables, tracks

STAMP_FORMAT = "yyyy/MM/dd HH:mm:ss"


def _meter_lines(t):
    """Meter file text rendered from events: some comment records, bad numbers and short rows."""
    e = t.events
    number = F.when(F.col("event_id") % 41 == 0, "n/a").otherwise(F.col("value").cast("string"))
    record = F.when(F.col("event_id") % 50 == 0, "C").otherwise("D")
    full = F.concat_ws(
        ",", record, F.lit("METER"), F.lit("UNIT"), F.lit("1"),
        F.concat(F.lit('"'), F.date_format("ts", STAMP_FORMAT), F.lit('"')),
        F.concat(F.lit("U"), F.col("user_id").cast("string")), number,
    )
    line = F.when(F.col("event_id") % 53 == 0, "D,METER,UNIT,1").otherwise(full)
    return e.select(line.alias("line"), F.col("event_id").alias("row_order"))


_METER_SQL = """
    SELECT event_id AS row_order, date_trunc('second', ts) AS stamp, 'U' || CAST(user_id AS VARCHAR) AS unit,
           user_id, value AS mw
    FROM events WHERE event_id % 41 <> 0 AND event_id % 50 <> 0 AND event_id % 53 <> 0"""


@query("meter_scan", "A1", "row_order:i stamp unit mw:f",
       f"SELECT * REPLACE (strftime(stamp, '%Y/%m/%d %H:%M:%S') AS stamp) FROM ({_METER_SQL}) m WHERE user_id IN (SELECT user_id FROM events WHERE value > 60)")
def _(t):
    known = t.events.where(F.col("value") > 60).select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("unit")
    ).distinct()
    return meter.parse_readings(_meter_lines(t), known)


@query("meter_units", "A3", "unit", f"SELECT DISTINCT unit FROM ({_METER_SQL}) m")
def _(t):
    return meter.distinct_units(meter.parse_readings(_meter_lines(t)))


@query("unit_station_map", "A5", "unit station",
       "SELECT 'U' || CAST(o_custkey AS VARCHAR) AS unit, arg_max('ST' || CAST(o_orderkey % 37 AS VARCHAR), o_orderkey) AS station FROM orders GROUP BY 1")
def _(t):
    lines = t.t("orders").select(
        F.concat_ws(",", F.lit("D"), F.lit("REG"), F.lit("UNITS"), F.lit("2"),
                    F.concat(F.lit("U"), F.col("o_custkey").cast("string")),
                    F.date_format("o_orderdate", STAMP_FORMAT),
                    F.concat(F.lit("ST"), (F.col("o_orderkey") % 37).cast("string"))).alias("line"),
        F.col("o_orderkey").alias("row_order"),
    )
    return meter.unit_stations(lines)


def _market_lines(t):
    """Files with quoted commas, sections and short rows.

    Odd files are of an older vintage without the wind column and order fields differently. Even files hold a
    second section (every 7th event) with an order of its own, a quoted remark, and rows cut short (every 17th).
    """
    e = t.events.withColumn("file", F.concat(F.lit("m"), (F.col("user_id") % 6).cast("string")))
    late = F.col("user_id") % 2 == 0
    stamp = F.date_format("ts", STAMP_FORMAT)
    region = F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string"))
    intervention = F.when(F.col("event_id") % 13 == 0, "1").otherwise("0")
    value = F.col("value").cast("string")
    wind = F.when(F.col("event_id") % 17 != 0, (F.col("value") * 2).cast("string"))
    new = F.concat_ws(",", F.lit("D"), F.lit("D"), F.lit("SUM"), F.lit("4"), stamp, F.lit('"late, ""held"""'), region, intervention, value, wind)
    alt = F.concat_ws(",", F.lit("D"), F.lit("D"), F.lit("ALT"), F.lit("1"), region, value, F.concat(F.lit('"'), stamp, F.lit('"')), intervention)
    new = F.when(F.col("event_id") % 7 == 0, alt).otherwise(new)
    old = F.concat_ws(",", F.lit("D"), F.lit("D"), F.lit("SUM"), F.lit("3"), region, stamp, value, intervention)
    rows = e.select("file", F.when(late, new).otherwise(old).alias("line"))
    names_new = F.lit('I,D,SUM,4,SETTLEMENTDATE,"RE, MARK",REGIONID,INTERVENTION,TOTALDEMAND,SS_WIND_UIGF')
    names_old = F.lit("I,D,SUM,3,REGIONID,SETTLEMENTDATE,TOTALDEMAND,INTERVENTION")
    heads = e.select("file", late.alias("late")).distinct().select(
        "file", F.when(F.col("late"), names_new).otherwise(names_old).alias("line")
    )
    second = e.where(late).select("file", F.lit("I,D,ALT,1,REGIONID,TOTALDEMAND,SETTLEMENTDATE,INTERVENTION").alias("line")).distinct()
    return rows.unionByName(heads).unionByName(second)


_MARKET_FIELDS = {"TOTALDEMAND": "demand_mw", "SS_WIND_UIGF": "wind_uigf_mw", "NETINTERCHANGE": "net_interchange_mw"}


@query("market_header_scan", "A2", "file region stamp demand_mw:f wind_uigf_mw:f net_interchange_mw:f", """
    SELECT 'm' || CAST(user_id % 6 AS VARCHAR) AS file, 'R' || CAST(user_id % 5 AS VARCHAR) AS region,
           strftime(ts, '%Y/%m/%d %H:%M:%S') AS stamp, value AS demand_mw,
           CASE WHEN user_id % 2 = 0 AND event_id % 7 <> 0 THEN value * 2 END AS wind_uigf_mw, CAST(NULL AS DOUBLE) AS net_interchange_mw
    FROM events WHERE event_id % 13 <> 0 AND (user_id % 2 = 1 OR event_id % 7 = 0 OR event_id % 17 <> 0)""")
def _(t):
    return market.parse_table(_market_lines(t), _MARKET_FIELDS, "SETTLEMENTDATE", filters={"INTERVENTION": "0"})


@query("market_file_status", "A18", "file rows:i status", """
    SELECT 'm' || CAST(user_id % 6 AS VARCHAR) AS file, count(CASE WHEN user_id % 2 = 0 AND event_id % 7 <> 0 AND event_id % 17 <> 0 THEN 1 END) AS rows,
           CASE WHEN count(CASE WHEN user_id % 2 = 0 AND event_id % 7 <> 0 AND event_id % 17 <> 0 THEN 1 END) > 0 THEN 'loaded' ELSE 'skipped' END AS status
    FROM events GROUP BY 1""")
def _(t):
    lines = _market_lines(t)
    parsed = market.parse_table(lines, {"SS_WIND_UIGF": "wind_uigf_mw"}, "SETTLEMENTDATE").where(
        F.col("wind_uigf_mw").isNotNull()
    )
    return market.file_status(lines, parsed)


@query("station_features", "A4 C25", "station name region_code longitude:f latitude:f fuels capacity_mw:f operating:b", """
    SELECT 'ST' || CAST(s_suppkey AS VARCHAR) AS station, s_name AS name,
           CASE s_suppkey % 3 WHEN 0 THEN 'NSW1' WHEN 1 THEN 'SA1' END AS region_code,
           CAST(110 + s_suppkey % 45 AS DOUBLE) + 0.5 AS longitude, CAST(s_suppkey % 60 - 40 AS DOUBLE) AS latitude,
           CASE WHEN s_suppkey % 2 = 0 THEN 'solar_utility' ELSE 'battery,wind' END AS fuels,
           abs(s_acctbal) + CASE WHEN s_suppkey % 2 = 0 THEN abs(s_acctbal) ELSE 10 END AS capacity_mw,
           s_suppkey % 4 <> 0 AS operating
    FROM supplier""")
def _(t):
    k = F.col("s_suppkey")
    lon, lat = ((k % 45) + 110).cast("double") + 0.5, (k % 60 - 40).cast("double")
    vertex = F.concat(F.lit("["), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit("]"))
    multi = k % 2 == 1
    coords = F.when(multi, F.concat(F.lit("["), vertex, F.lit(",[0.0,0.0]]"))).otherwise(vertex)
    solar = k % 2 == 0

    def unit(fuel, cap, status):
        return F.concat(F.lit('{"fuel_tech":"'), fuel, F.lit('","capacity_registered":'), cap.cast("string"),
                        F.lit(',"status":"'), status, F.lit('"}'))

    bal = F.abs("s_acctbal")
    first = unit(F.when(solar, "solar_utility").otherwise("wind"), bal, F.when(k % 4 == 0, "retired").otherwise("operating"))
    second = unit(F.when(solar, "solar_utility").otherwise("battery"), F.when(solar, bal).otherwise(10.0), F.lit("retired"))
    state = F.when(k % 3 == 0, "NSW").when(k % 3 == 1, "SA").otherwise("XX")
    feature = F.concat(
        F.lit('{"type":"Feature","geometry":{"type":"'), F.when(multi, "MultiPoint").otherwise("Point"),
        F.lit('","coordinates":'), coords, F.lit('},"properties":{"station_code":"ST'), k.cast("string"),
        F.lit('","name":"'), F.col("s_name"), F.lit('","state":"'), state, F.lit('","duid_data":['), first, F.lit(","), second, F.lit("]}}"),
    )
    parsed = stations.parse_features(t.t("supplier").select(feature.alias("feature")))
    return parsed.withColumn("fuels", F.concat_ws(",", "fuels")).withColumn(
        "region_code", stations.market_region(F.col("state"))
    )


def _solar_track(t):
    """Wide solar track from the dense grid: radiation accumulates within each daily run."""
    from pyspark.sql import Window

    from gridloom.functions import clock

    g = t.grid.where(F.col("tech") == "solar").withColumn("v", F.coalesce("power_mw", F.lit(0.0)))
    w = Window.partitionBy("site_id", clock.run_issue(F.col("valid_time"))).orderBy("valid_time").rowsBetween(
        Window.unboundedPreceding, 0
    )
    return g.select(
        F.substring("site_id", 2, 10).alias("ZONEID"),
        F.date_format("valid_time", "yyyyMMdd H:mm").alias("TIMESTAMP"),
        F.lit(101325.0).alias("VAR134"), (F.col("v") * 3).alias("VAR157"), (F.col("v") / 50).alias("VAR164"),
        (F.col("v") - 5).alias("VAR165"), (F.col("v") / 2).alias("VAR166"), (F.col("v") + 273.15).alias("VAR167"),
        F.sum(F.col("v") * 3600).over(w).alias("VAR169"), F.col("v").alias("VAR175"), F.col("v").alias("VAR178"),
        F.col("v").alias("VAR228"), F.col("power_mw").alias("POWER"),
    )


@query("solar_track_weather", "A6 C2 C3 E5 F6", "site_id issue_time_utc:t valid_time_utc:t horizon_h:i ghi_wm2:f cloud_total:f temp_2m_c:f rh_pct:f pressure_hpa:f precip_mm:f wind_speed_10m:f", """
    SELECT 'ZONE-SOLAR-' || substr(site_id, 2) AS site_id,
           date_trunc('day', valid_time - INTERVAL 1 HOUR) AS issue_time_utc, valid_time AS valid_time_utc,
           date_diff('hour', date_trunc('day', valid_time - INTERVAL 1 HOUR), valid_time) AS horizon_h,
           v AS ghi_wm2, least(v / 50, 1) AS cloud_total, v AS temp_2m_c, least(v * 3, 100) AS rh_pct,
           1013.25 AS pressure_hpa, v * 1000 AS precip_mm, sqrt((v - 5) * (v - 5) + v * v / 4) AS wind_speed_10m
    FROM (SELECT *, coalesce(power_mw, 0) AS v FROM x_grid WHERE tech = 'solar')""")
def _(t):
    raw = tracks.with_run(_solar_track(t))
    flat = tracks.deaccumulate(raw, list(tracks.ACCUMULATED), ["ZONEID", "issue_time_utc"], "valid_time_utc")
    return tracks.solar_weather(flat)


@query("accumulation_check", "E5", "column rising_share:f", """
    WITH g AS (SELECT site_id, valid_time, date_trunc('day', valid_time - INTERVAL 1 HOUR) AS run, coalesce(power_mw, 0) AS v
               FROM x_grid WHERE tech = 'solar'),
    d AS (SELECT site_id, run, v - lag(v) OVER (PARTITION BY site_id, run ORDER BY valid_time) AS dv FROM g),
    s AS (SELECT site_id, run, avg(CASE WHEN dv IS NOT NULL THEN CAST(dv >= -0.000001 AS INTEGER) END) AS share FROM d GROUP BY ALL)
    SELECT 'VAR169' AS "column", 1.0 AS rising_share UNION ALL SELECT 'VAR175', avg(share) FROM s""")
def _(t):
    raw = tracks.with_run(_solar_track(t))
    return tracks.rising_shares(raw, ["VAR169", "VAR175"], ["ZONEID", "issue_time_utc"], "valid_time_utc")


@query("wind_track_power", "A6", "site_id valid_time_utc:t tech power_mw:f capacity_mw:f is_valid:b", """
    SELECT 'ZONE-WIND-' || substr(site_id, 2) AS site_id, valid_time AS valid_time_utc, 'wind' AS tech,
           power_mw * 2 AS power_mw, 2.0 AS capacity_mw, power_mw IS NOT NULL AS is_valid FROM x_grid WHERE tech = 'wind'""")
def _(t):
    raw = t.grid.where(F.col("tech") == "wind").select(
        F.substring("site_id", 2, 10).alias("ZONEID"), F.date_format("valid_time", "yyyyMMdd H:mm").alias("TIMESTAMP"),
        F.col("power_mw").alias("TARGETVAR"),
    )
    return tracks.track_power(tracks.with_run(raw), "TARGETVAR", "wind", "ZONE-WIND-", 2.0)


@query("wind_track_weather", "A6 C4", "site_id issue_time_utc:t valid_time_utc:t wind_speed_10m:f wind_speed_100m:f wind_dir_100m_deg:f", """
    SELECT 'ZONE-WIND-' || substr(site_id, 2) AS site_id, date_trunc('day', valid_time - INTERVAL 1 HOUR) AS issue_time_utc,
           valid_time AS valid_time_utc, sqrt(v * v + 4) AS wind_speed_10m, sqrt((v + 1) * (v + 1) + 9) AS wind_speed_100m,
           (270 - degrees(atan2(CAST(-3 AS DOUBLE), v + 1)) + 360) % 360 AS wind_dir_100m_deg
    FROM (SELECT *, coalesce(power_mw, CAST(0 AS DOUBLE)) AS v FROM x_grid WHERE tech = 'wind')""")
def _(t):
    v = F.coalesce("power_mw", F.lit(0.0))
    raw = t.grid.where(F.col("tech") == "wind").select(
        F.substring("site_id", 2, 10).alias("ZONEID"), F.date_format("valid_time", "yyyyMMdd H:mm").alias("TIMESTAMP"),
        v.alias("U10"), F.lit(2.0).alias("V10"), (v + 1).alias("U100"), F.lit(-3.0).alias("V100"),
    )
    return tracks.wind_weather(tracks.with_run(raw))


def _daily_payloads(t, fields):
    """One JSON block per site and day, 24 hours at most, from the weather view at the 24 h lead."""
    rows = t.weather.where(F.col("horizon_h") == 24).withColumn("day", F.date_trunc("day", "valid_time"))
    item = F.struct("valid_time", *[c.alias(n) for n, c in fields.items()])
    blocks = rows.groupBy("site_id", "day").agg(F.array_sort(F.collect_list(item)).alias("b"))
    arrays = [F.col(f"b.{n}").alias(n) for n in fields]
    times = F.transform("b", lambda x: F.date_format(x["valid_time"], "yyyy-MM-dd'T'HH:mm")).alias("time")
    payload = F.to_json(F.struct(F.struct(times, *arrays).alias("hourly")), {"ignoreNullFields": "false"})
    return blocks.select("site_id", F.col("day").alias("issue_time"), payload.alias("payload"))


@query("hourly_json_rows", "A7 C3", "site_id issue_time:t valid_time:t horizon_h:i ghi_wm2:f cloud_total:f temp_2m_c:f pressure_hpa:f dni_wm2:f source", """
    SELECT site_id, date_trunc('day', valid_time) AS issue_time, valid_time, hour(valid_time) AS horizon_h, ghi_wm2, cloud_total,
           temp_2m_c, pressure_hpa, CAST(NULL AS DOUBLE) AS dni_wm2, 'forecast' AS source FROM x_weather WHERE horizon_h = 24""")
def _(t):
    fields = {"shortwave_radiation": F.col("ghi_wm2"), "cloud_cover": F.col("cloud_total") * 100,
              "temperature_2m": F.col("temp_2m_c"), "surface_pressure": F.col("pressure_hpa")}
    return hourly_json.hourly_rows(_daily_payloads(t, fields))


@query("lead_json_rows", "A8 C5 C6", "site_id issue_time:t valid_time:t horizon_h:i ghi_wm2:f cloud_total:f pressure_hpa:f", """
    SELECT site_id, valid_time - to_hours(CAST(d * 24 AS INTEGER)) AS issue_time, valid_time, d * 24 AS horizon_h,
           CASE WHEN d = 1 THEN greatest(ghi_wm2 - 100, 0) END AS ghi_wm2, CASE WHEN d = 1 THEN cloud_total END AS cloud_total,
           CASE WHEN d = 2 THEN pressure_hpa END AS pressure_hpa
    FROM x_weather CROSS JOIN (VALUES (1), (2), (3)) v(d)
    WHERE horizon_h = 24 AND (d = 1 OR (d = 2 AND pressure_hpa IS NOT NULL))""")
def _(t):
    fields = {"shortwave_radiation_previous_day1": F.col("ghi_wm2") - 100,
              "cloud_cover_previous_day1": F.col("cloud_total") * 100,
              "surface_pressure_previous_day2": F.col("pressure_hpa")}
    return hourly_json.lead_rows(_daily_payloads(t, fields))


@query("canonical_read", "A9 U1", "event_id:i user_id:i value:f",
       "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 10")
def _(t):
    frame = t.spark.read.parquet(f"{t.dir}/events.parquet")
    return frame.where((F.col("event_type") == "click") & (F.col("value") > 10)).select("event_id", "user_id", "value")


@query("preferred_corpora", "A10", "corpus preference:i", """
    SELECT event_type AS corpus, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'error' THEN 3 END AS preference
    FROM events WHERE event_type IN ('view', 'click', 'error') GROUP BY event_type
    HAVING count(DISTINCT user_id % 2) = 2""")
def _(t):
    halves = t.events.select(
        F.col("event_type").alias("corpus"), F.when(F.col("user_id") % 2 == 0, "weather").otherwise("power").alias("half")
    ).distinct()
    return tables.preferred_corpora(halves, ["view", "click", "error"])


@query("canonical_partitions", "A11", "tech month rows:i sites:i", """
    SELECT tech, strftime(valid_time, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT site_id) AS sites
    FROM x_hourly GROUP BY 1, 2""")
def _(t):
    per_site = t.hourly.groupBy("tech", F.date_format("valid_time", "yyyy-MM").alias("month"), "site_id").count()
    return per_site.groupBy("tech", "month").agg(F.sum("count").alias("rows"), F.count("*").alias("sites"))


@query("month_reload", "A11", "region month rows:i demand:f", """
    SELECT region, strftime(valid_time, '%Y-%m') AS month, count(*) AS rows, sum(CASE WHEN strftime(valid_time, '%Y-%m') IN ('1995-03', '1996-11') AND hour(valid_time) < 12 THEN demand_mw * 2 ELSE demand_mw END) AS demand
    FROM x_history GROUP BY 1, 2""")
def _(t):
    """A table of all months, then half of the hours of two months loaded again, twice: corrected there, nothing repeated or lost."""
    path = f"{shared_dir(t.spark)}/tables/{uuid.uuid4().hex}"
    keep_until_end(path)
    rows = t.history.select("region", "valid_time", "demand_mw")
    again = rows.where(F.date_format("valid_time", "yyyy-MM").isin("1995-03", "1996-11") & (F.hour("valid_time") < 12)).withColumn("demand_mw", F.col("demand_mw") * 2)
    for part in (rows, again, again):
        tables.load_months(part, path, by=("region",), key=("valid_time",))
    return t.spark.read.parquet(path).groupBy("region", "month").agg(F.count("*").alias("rows"), F.sum("demand_mw").alias("demand"))


@query("site_dimension", "A12 C26", "site_id tech tilt_deg:f azimuth_deg:f hub_height_m:f rotor_diameter_m:f", """
    SELECT site_id, tech, CASE WHEN tilt_deg IS NULL AND tech = 'solar' THEN least(abs(latitude), 40) ELSE tilt_deg END AS tilt_deg,
           CASE WHEN azimuth_deg IS NULL AND tech = 'solar' THEN CASE WHEN latitude >= 0 THEN 180 ELSE 0 END ELSE azimuth_deg END AS azimuth_deg,
           CASE WHEN hub_height_m IS NULL AND tech = 'wind' THEN 100 ELSE hub_height_m END AS hub_height_m,
           CASE WHEN rotor_diameter_m IS NULL AND tech = 'wind' THEN 90 ELSE rotor_diameter_m END AS rotor_diameter_m
    FROM x_sites""")
def _(t):
    return tables.with_site_defaults(t.sites)


@query("site_upsert", "A13", "site_id name capacity_mw:f tilt_deg:f", """
    SELECT site_id, CASE WHEN capacity_mw < 50 THEN name ELSE 'new' END AS name,
           CASE WHEN capacity_mw > 35 THEN 99 ELSE capacity_mw END AS capacity_mw,
           CASE WHEN capacity_mw < 50 THEN tilt_deg END AS tilt_deg
    FROM x_sites WHERE capacity_mw < 50 OR capacity_mw > 35""")
def _(t):
    cap = F.col("capacity_mw")
    old = t.sites.where(cap < 50).select("site_id", "name", "capacity_mw", "tilt_deg")
    new = t.sites.where(cap > 35).select(
        "site_id", F.when(cap >= 50, "new").alias("name"), F.lit(99.0).alias("capacity_mw"), F.lit(None).cast("double").alias("tilt_deg")
    )
    return tables.upsert(old, new, "site_id")


@query("nested_payload", "A14", "region month:i n_points:i total:f", """
    SELECT region, month(valid_time) AS month, count(*) AS n_points, sum(s) AS total FROM (
      SELECT region, valid_time, coalesce(demand_mw, 0) AS s FROM x_market) GROUP BY ALL""")
def _(t):
    points = t.market.select(
        "region", F.month("valid_time").alias("month"), "valid_time", F.coalesce("demand_mw", F.lit(0.0)).alias("s")
    )
    nested = payloads.nest(points, ["region", "month"], "valid_time", ["s"])
    return nested.select(
        "region", "month", F.size("points").alias("n_points"),
        F.aggregate("points", F.lit(0.0), lambda a, p: a + p["s"]).alias("total"),
    )


@query("metadata_trained_sites", "A15", "site_id", "SELECT DISTINCT 'S' || CAST(l_suppkey AS VARCHAR) AS site_id FROM lineitem")
def _(t):
    # One metadata document per order; an order is a small group.
    docs = t.t("lineitem").groupBy("l_orderkey").agg(
        F.to_json(F.struct(F.collect_set(F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).alias("trained_sites"))).alias("document")
    )
    return payloads.trained_sites(docs)


@query("metadata_region_accuracy", "A15", "region nmae:f coverage:f",
       "SELECT r_name AS region, CAST(n_nationkey AS DOUBLE) / 10 AS nmae, 0.8 AS coverage FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    inner = F.concat(F.lit('{"regions":{"'), F.col("r_name"), F.lit('":{"nmae":'), (F.col("n_nationkey") / 10).cast("string"), F.lit(',"coverage":0.8}}}'))
    return payloads.region_accuracy(t.places.select(inner.alias("document")))


@query("month_range", "A17", "month:d", """
    SELECT unnest(generate_series(date_trunc('month', min(o_orderdate)),
        date_trunc('month', max(o_orderdate) + INTERVAL 1 DAY) - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS month FROM orders""")
def _(t):
    spans = t.t("orders").agg(F.min("o_orderdate").alias("lo"), F.max("o_orderdate").alias("hi"))
    return tables.month_range(spans, "lo", "hi")


@query("flat_export", "A19", "line", """
    SELECT site_id || ',' || strftime(valid_time, '%Y-%m-%dT%H:%M:%SZ') || ',' || CAST(horizon_h AS VARCHAR) || ',' ||
           CAST(CAST(round(p50_mw * 1000) AS BIGINT) AS VARCHAR) AS line FROM x_eval""")
def _(t):
    from gridloom.functions.clock import iso_z

    flat = t.eval.select("site_id", iso_z(F.col("valid_time")).alias("ts"), "horizon_h", F.round(F.col("p50_mw") * 1000).cast("long").alias("kw"))
    return flat.select(F.to_csv(F.struct(*flat.columns)).alias("line"))


@query("fixture_rebase", "A20", "site_id valid_time:t issue_time:t source power_mw:f", """
    SELECT site_id, TIMESTAMP '2025-06-01 00:00:00' + (valid_time - min(valid_time) OVER (PARTITION BY site_id)) AS valid_time,
           TIMESTAMP '2025-06-01 00:00:00' AS issue_time, 'fixture' AS source, power_mw FROM x_grid""")
def _(t):
    return hourly_json.rebase(t.grid.select("site_id", "valid_time", "power_mw"), ["site_id"], F.lit("2025-06-01 00:00:00").cast("timestamp"))
