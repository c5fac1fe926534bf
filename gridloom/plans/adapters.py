"""Energy-shaped views of the driver's tables, once as DataFrames and once as SQL CTEs.

| view | from | grain |
|---|---|---|
| readings | events | one meter reading; ten users make a site, five sites rotate over regions |
| hourly | readings | site x hour, mean power |
| grid | hourly | dense site x hour calendar, missing hours NULL |
| leads | grid | site x hour x lead (24/48/72 h), a scaled persistence band |
| weather | grid | site x hour x lead, weather variables derived from the readings |
| market | events | region x hour, demand, available renewables, price |
| history | lineitem, supplier, nation, region | region x hour over seven years |
| daily | orders, customer, nation, region | region x date |
| sites | supplier | site dimension |

All grow with the tables: more users give more sites, more lines fill more regional hours.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators.resample import dense_hours, hourly_mean
from gridloom.session import materialise, prepare

LEADS = (24, 48, 72)
# Keeps regional demand off exact ties with generation, where float noise would decide an event.
BASE_LOAD = 0.2513

# The local clock of each of the five regions.
REGION_CLOCKS = {
    "R0": "Australia/Sydney",
    "R1": "Australia/Brisbane",
    "R2": "Australia/Adelaide",
    "R3": "Australia/Hobart",
    "R4": "Australia/Melbourne",
}


def _hour_of(column: str) -> Column:
    return F.date_trunc("hour", F.col(column))


class Tables:
    """Lazy views over one data folder. Holds plans only, never data."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    def t(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        # Zone-less stamps become instants on the UTC session clock.
        for field in frame.schema.fields:
            if field.dataType.typeName() == "timestamp_ntz":
                frame = frame.withColumn(field.name, F.col(field.name).cast("timestamp"))
        return frame

    @cached_property
    def events(self) -> DataFrame:
        return self.t("events")

    @cached_property
    def readings(self) -> DataFrame:
        number = F.expr("user_id div 10")
        return self.events.select(
            "event_id",
            F.concat(F.lit("S"), number.cast("string")).alias("site_id"),
            F.concat(F.lit("R"), (number % 5).cast("string")).alias("region"),
            F.when(number % 2 == 0, "solar").otherwise("wind").alias("tech"),
            "ts",
            F.col("value").alias("mw"),
        )

    @cached_property
    def hourly(self) -> DataFrame:
        return hourly_mean(
            self.readings, ["site_id", "region", "tech"], "ts", "mw", out="power_mw"
        )

    @cached_property
    def grid(self) -> DataFrame:
        return dense_hours(self.hourly, ["site_id", "region", "tech"], "valid_time", ["power_mw"])

    @cached_property
    def leads(self) -> DataFrame:
        w = Window.partitionBy("site_id").orderBy("valid_time")
        lagged = self.grid.select(
            "*", *[F.lag("power_mw", h).over(w).alias(f"p{h}") for h in LEADS]
        )
        pairs = F.explode(
            F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"p{h}").alias("p")) for h in LEADS])
        )
        p50 = F.coalesce(F.col("lead.p"), F.lit(0.0))
        return lagged.select(
            "site_id", "region", "tech", "valid_time", "power_mw", pairs.alias("lead")
        ).select(
            "site_id",
            "region",
            "tech",
            "valid_time",
            F.col("lead.h").alias("horizon_h"),
            (F.col("valid_time") - F.make_dt_interval(hours=F.col("lead.h"))).alias("issue_time"),
            (p50 * 0.6).alias("p10_mw"),
            p50.alias("p50_mw"),
            (p50 * 1.4).alias("p90_mw"),
            F.col("power_mw").alias("actual_mw"),
        )

    @cached_property
    def weather(self) -> DataFrame:
        v = F.coalesce(F.col("power_mw"), F.lit(0.0))
        hour = F.hour("valid_time")
        sun = F.greatest(F.lit(0.0), F.sin(F.lit(3.141592653589793) * (hour - 6) / 12.0))
        base = self.grid.select(
            "site_id",
            "region",
            "tech",
            "valid_time",
            F.explode(F.array(*[F.lit(h) for h in LEADS])).alias("horizon_h"),
            v.alias("v"),
            sun.alias("sun"),
            hour.alias("hour"),
            F.col("power_mw").isNull().alias("silent"),
        )
        return base.select(
            "site_id",
            "region",
            "tech",
            (F.col("valid_time") - F.make_dt_interval(hours=F.col("horizon_h"))).alias("issue_time"),
            "valid_time",
            "horizon_h",
            (F.lit(900.0) * F.col("sun") * (1 - F.least(F.lit(1.0), F.col("v") / 60.0))).alias("ghi_wm2"),
            F.least(F.lit(1.0), F.col("v") / 60.0).alias("cloud_total"),
            F.when(~F.col("silent"), F.least(F.lit(1.0), F.col("v") / 90.0)).alias("cloud_low"),
            (F.lit(12.0) + 10.0 * F.col("sun") + F.col("v") / 10.0 + F.col("horizon_h") / 24.0).alias("temp_2m_c"),
            F.when(~F.col("silent"), F.lit(1000.0) + F.col("v") % 25.0).alias("pressure_hpa"),
            (F.lit(1.0) + F.col("v") / 8.0).alias("wind_speed_10m"),
            (F.lit(2.0) + F.col("v") / 6.0 + F.col("horizon_h") / 48.0).alias("wind_speed_100m"),
            ((F.col("v") * 11.0 + F.col("hour") * 15.0) % 360.0).alias("wind_dir_10m_deg"),
            ((F.col("v") * 13.0 + F.col("hour") * 20.0) % 360.0).alias("wind_dir_100m_deg"),
        )

    @cached_property
    def market(self) -> DataFrame:
        kind = F.col("event_type")
        value = F.col("value")
        zero = F.lit(0.0)
        solar = F.sum(F.when(kind == "signup", value))
        wind = F.sum(F.when(kind == "error", value))
        region = F.concat(F.lit("R"), (F.expr("user_id div 10") % 5).cast("string"))
        return (
            self.events.groupBy(region.alias("region"), _hour_of("ts").alias("valid_time"))
            .agg(
                F.coalesce(F.sum(F.when(kind.isin("purchase", "view", "click"), value)), zero).alias("demand_mw"),
                (F.sum("value") + 20.0).alias("available_generation_mw"),
                (
                    F.sum(F.when(kind == "purchase", value).otherwise(0.0))
                    - F.sum(F.when(kind == "view", value).otherwise(0.0))
                ).alias("net_interchange_mw"),
                solar.alias("solar_uigf_mw"),
                wind.alias("wind_uigf_mw"),
                (solar * 0.8).alias("solar_cleared_mw"),
                (wind * 0.9).alias("wind_cleared_mw"),
                (F.avg("value") - 10.0).alias("rrp_aud_mwh"),
                (solar * 0.1).alias("rooftop_pv_mw"),
            )
        )

    @cached_property
    def market_grid(self) -> DataFrame:
        values = [c for c in self.market.columns if c not in ("region", "valid_time")]
        return dense_hours(self.market, ["region"], "valid_time", values)

    @cached_property
    def places(self) -> DataFrame:
        """Nation to region number and name; 25 rows."""
        return self.t("nation").join(
            self.t("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )

    @cached_property
    def history(self) -> DataFrame:
        lines = self.t("lineitem").select(
            "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
            "l_returnflag", "l_shipdate",
        )
        suppliers = self.t("supplier").select("s_suppkey", "s_nationkey")
        located = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(
            self.places.select("n_nationkey", "r_regionkey"),
            F.col("s_nationkey") == F.col("n_nationkey"),
        )
        flag, q = F.col("l_returnflag"), F.col("l_quantity")
        solar = F.sum(F.when(flag == "R", q * 1.5))
        wind = F.sum(F.when(flag == "A", q * F.col("l_tax") * 20.0))
        return located.groupBy(
            F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("region"),
            (
                F.date_trunc("day", F.col("l_shipdate"))
                + F.make_dt_interval(hours=(F.col("l_partkey") % 24).cast("int"))
            ).alias("valid_time"),
        ).agg(
            F.sum("l_quantity").alias("demand_mw"),
            solar.alias("solar_uigf_mw"),
            wind.alias("wind_uigf_mw"),
            (solar * 0.1).alias("solar_curtailed_mw"),
            (wind * 0.2).alias("wind_curtailed_mw"),
            (F.avg("l_extendedprice") / 1000.0 - 20.0).alias("rrp_aud_mwh"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        orders = self.t("orders").join(
            self.t("customer").select("c_custkey", "c_nationkey"),
            F.col("o_custkey") == F.col("c_custkey"),
        )
        located = orders.join(
            self.places.select("n_nationkey", "r_name"), F.col("c_nationkey") == F.col("n_nationkey")
        )
        urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
        return located.groupBy(
            F.col("r_name").alias("region"), F.to_date("o_orderdate").alias("date")
        ).agg(
            F.sum(F.when(urgent, F.col("o_totalprice")).otherwise(0.0)).alias("renewable_mwh"),
            F.sum("o_totalprice").alias("demand_mwh"),
            F.count("*").alias("n_orders"),
        )

    @cached_property
    def sites(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.t("supplier").select(
            F.concat(F.lit("S"), k.cast("string")).alias("site_id"),
            F.col("s_name").alias("name"),
            F.when(k % 2 == 0, "solar").otherwise("wind").alias("tech"),
            (F.abs("s_acctbal") / 200.0 + 20.0).alias("capacity_mw"),
            ((k * 7) % 61 - 40).cast("double").alias("latitude"),
            ((k % 45) + 110).cast("double").alias("longitude"),
            F.concat(F.lit("R"), (k % 5).cast("string")).alias("market_region"),
            F.when(k % 3 != 0, (k % 30).cast("double")).alias("tilt_deg"),
            F.when(k % 4 != 0, (k % 2) * 180.0).alias("azimuth_deg"),
            F.when(k % 7 != 0, (k % 5) * 10.0 + 80.0).alias("hub_height_m"),
            F.when(k % 7 != 0, (k % 4) * 10.0 + 80.0).alias("rotor_diameter_m"),
            ((k % 3) * 0.5 + 11.5).alias("rated_ws_ms"),
            F.lit(3.0).alias("cut_in_ws_ms"),
            F.lit(25.0).alias("cut_out_ws_ms"),
        )

    @cached_property
    def eval(self) -> DataFrame:
        """Predictions with a known outcome, plus capacity."""
        caps = self.sites.select("site_id", "capacity_mw")
        return self.leads.where(F.col("actual_mw").isNotNull()).join(caps, "site_id")

    @cached_property
    def residuals(self) -> DataFrame:
        """Long error store at the 24 h lead on the dense calendar; silent hours read as zero."""
        caps = self.sites.select("site_id", "capacity_mw")
        return (
            self.leads.where(F.col("horizon_h") == 24)
            .join(caps, "site_id")
            .select(
                "valid_time", "site_id", "region", "tech", "capacity_mw", "p50_mw",
                F.coalesce("actual_mw", F.lit(0.0)).alias("actual_mw"),
                (
                    (F.coalesce("actual_mw", F.lit(0.0)) - F.col("p50_mw")) / F.col("capacity_mw")
                ).alias("residual"),
            )
        )


    @cached_property
    def demand(self) -> DataFrame:
        """Regional demand on the dense calendar with a day-ahead forecast and its scaled error."""
        w = Window.partitionBy("region").orderBy("valid_time")
        zero = F.lit(0.0)
        rows = self.market_grid.select(
            "region", "valid_time", (F.coalesce("demand_mw", zero) + BASE_LOAD).alias("actual_mw"),
            (F.coalesce(F.lag("demand_mw", 24).over(w), zero) + BASE_LOAD).alias("p50_mw"),
        )
        peaks = rows.groupBy("region").agg(F.percentile("actual_mw", F.lit(0.999)).alias("peak_mw"))
        return rows.join(peaks, "region").withColumn(
            "residual", (F.col("actual_mw") - F.col("p50_mw")) / F.col("peak_mw")
        )


    def stored(self, name: str) -> DataFrame:
        """A view written once per session and data folder, as a pipeline stage would leave it.

        The error stores are read by several branches of one scenario plan.
        """
        key = (self.spark.sparkContext.applicationId, folder_state(self.spark, self.dir), name)
        if key not in _STORED:
            _STORED[key] = materialise(getattr(self, name))
        return _STORED[key]


_STORED: dict[tuple[str, str, str], DataFrame] = {}


def folder_state(spark: SparkSession, folder: str) -> str:
    """The folder with names, sizes and times of its tables: what is kept for it is not used once they change."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted(f"{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}" for f in fs.listStatus(path))
    return f"{folder} {' '.join(found)}"

CTES: dict[str, str] = {
    "x_readings": """
        SELECT event_id, 'S' || CAST(user_id // 10 AS VARCHAR) AS site_id,
               'R' || CAST((user_id // 10) % 5 AS VARCHAR) AS region,
               CASE WHEN (user_id // 10) % 2 = 0 THEN 'solar' ELSE 'wind' END AS tech,
               ts, value AS mw
        FROM events""",
    "x_hourly": """
        SELECT site_id, region, tech, date_trunc('hour', ts) AS valid_time,
               avg(CASE WHEN mw < 0 THEN 0 ELSE mw END) AS power_mw
        FROM x_readings GROUP BY ALL""",
    "x_grid": """
        SELECT c.site_id, c.region, c.tech, c.valid_time, h.power_mw
        FROM (SELECT site_id, region, tech,
                     unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 HOUR)) AS valid_time
              FROM x_hourly GROUP BY site_id, region, tech) c
        LEFT JOIN x_hourly h ON c.site_id = h.site_id AND c.valid_time = h.valid_time""",
    "x_leads": """
        SELECT g.site_id, g.region, g.tech, g.valid_time, l.h AS horizon_h,
               g.valid_time - to_hours(CAST(l.h AS INTEGER)) AS issue_time,
               0.6 * coalesce(p.power_mw, 0) AS p10_mw, coalesce(p.power_mw, 0) AS p50_mw,
               1.4 * coalesce(p.power_mw, 0) AS p90_mw, g.power_mw AS actual_mw
        FROM x_grid g CROSS JOIN (VALUES (24), (48), (72)) l(h)
        LEFT JOIN x_hourly p ON p.site_id = g.site_id
             AND p.valid_time = g.valid_time - to_hours(CAST(l.h AS INTEGER))""",
    "x_weather": """
        SELECT site_id, region, tech, valid_time - to_hours(CAST(h AS INTEGER)) AS issue_time,
               valid_time, h AS horizon_h,
               CAST(900 AS DOUBLE) * sun * (1 - least(1, v / 60)) AS ghi_wm2,
               least(CAST(1 AS DOUBLE), v / 60) AS cloud_total,
               CASE WHEN power_mw IS NOT NULL THEN least(CAST(1 AS DOUBLE), v / 90) END AS cloud_low,
               CAST(12 AS DOUBLE) + 10 * sun + v / 10 + h / 24 AS temp_2m_c,
               CASE WHEN power_mw IS NOT NULL THEN CAST(1000 AS DOUBLE) + v % 25 END AS pressure_hpa,
               CAST(1 AS DOUBLE) + v / 8 AS wind_speed_10m,
               CAST(2 AS DOUBLE) + v / 6 + h / 48 AS wind_speed_100m,
               (v * 11 + hod * 15) % 360 AS wind_dir_10m_deg,
               (v * 13 + hod * 20) % 360 AS wind_dir_100m_deg
        FROM (SELECT g.*, l.h, coalesce(power_mw, CAST(0 AS DOUBLE)) AS v, hour(valid_time) AS hod,
                     greatest(CAST(0 AS DOUBLE), sin(CAST(3.141592653589793 AS DOUBLE) * (hour(valid_time) - 6) / CAST(12 AS DOUBLE))) AS sun
              FROM x_grid g CROSS JOIN (VALUES (24), (48), (72)) l(h))""",
    "x_market": """
        SELECT 'R' || CAST((user_id // 10) % 5 AS VARCHAR) AS region,
               date_trunc('hour', ts) AS valid_time,
               coalesce(sum(CASE WHEN event_type IN ('purchase', 'view', 'click') THEN value END), 0) AS demand_mw,
               sum(value) + 20 AS available_generation_mw,
               sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END)
                 - sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS net_interchange_mw,
               sum(CASE WHEN event_type = 'signup' THEN value END) AS solar_uigf_mw,
               sum(CASE WHEN event_type = 'error' THEN value END) AS wind_uigf_mw,
               sum(CASE WHEN event_type = 'signup' THEN value END) * 0.8 AS solar_cleared_mw,
               sum(CASE WHEN event_type = 'error' THEN value END) * 0.9 AS wind_cleared_mw,
               avg(value) - 10 AS rrp_aud_mwh,
               sum(CASE WHEN event_type = 'signup' THEN value END) * 0.1 AS rooftop_pv_mw
        FROM events GROUP BY ALL""",
    "x_market_grid": """
        SELECT c.region, c.valid_time, m.* EXCLUDE (region, valid_time)
        FROM (SELECT region, unnest(generate_series(min(valid_time), max(valid_time), INTERVAL 1 HOUR)) AS valid_time
              FROM x_market GROUP BY region) c
        LEFT JOIN x_market m ON c.region = m.region AND c.valid_time = m.valid_time""",
    "x_history": """
        SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS region,
               date_trunc('day', l_shipdate) + to_hours(CAST(l_partkey % 24 AS INTEGER)) AS valid_time,
               sum(l_quantity) AS demand_mw,
               sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * 1.5 END) AS solar_uigf_mw,
               sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_tax * 20 END) AS wind_uigf_mw,
               sum(CASE WHEN l_returnflag = 'R' THEN l_quantity * 1.5 END) * 0.1 AS solar_curtailed_mw,
               sum(CASE WHEN l_returnflag = 'A' THEN l_quantity * l_tax * 20 END) * 0.2 AS wind_curtailed_mw,
               avg(l_extendedprice) / 1000 - 20 AS rrp_aud_mwh
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        GROUP BY ALL""",
    "x_balance": """
        SELECT *, demand_mw - renewable_mw AS residual_mw,
               greatest(renewable_mw - demand_mw, 0) AS surplus_mw
        FROM (SELECT *, coalesce(solar_uigf_mw, 0) + coalesce(wind_uigf_mw, 0) AS renewable_mw,
                     coalesce(solar_curtailed_mw, 0) + coalesce(wind_curtailed_mw, 0) AS curtailed_mw,
                     hour(local_time) AS local_hour, month(local_time) AS month,
                     CAST(local_time AS DATE) AS date
              FROM (SELECT *, (valid_time AT TIME ZONE 'UTC') AT TIME ZONE CASE region
                        WHEN 'R0' THEN 'Australia/Sydney' WHEN 'R1' THEN 'Australia/Brisbane'
                        WHEN 'R2' THEN 'Australia/Adelaide' WHEN 'R3' THEN 'Australia/Hobart'
                        ELSE 'Australia/Melbourne' END AS local_time
                    FROM x_history))""",
    "x_daily": """
        SELECT r_name AS region, CAST(o_orderdate AS DATE) AS date,
               sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_totalprice ELSE 0 END) AS renewable_mwh,
               sum(o_totalprice) AS demand_mwh, count(*) AS n_orders
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "x_sites": """
        SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS site_id, s_name AS name,
               CASE WHEN s_suppkey % 2 = 0 THEN 'solar' ELSE 'wind' END AS tech,
               abs(s_acctbal) / 200 + 20 AS capacity_mw,
               CAST((s_suppkey * 7) % 61 - 40 AS DOUBLE) AS latitude,
               CAST(s_suppkey % 45 + 110 AS DOUBLE) AS longitude,
               'R' || CAST(s_suppkey % 5 AS VARCHAR) AS market_region,
               CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 30 AS DOUBLE) END AS tilt_deg,
               CASE WHEN s_suppkey % 4 <> 0 THEN CAST((s_suppkey % 2) * 180 AS DOUBLE) END AS azimuth_deg,
               CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_suppkey % 5) * 10 + 80 AS DOUBLE) END AS hub_height_m,
               CASE WHEN s_suppkey % 7 <> 0 THEN CAST((s_suppkey % 4) * 10 + 80 AS DOUBLE) END AS rotor_diameter_m,
               CAST((s_suppkey % 3) * 0.5 + 11.5 AS DOUBLE) AS rated_ws_ms,
               CAST(3 AS DOUBLE) AS cut_in_ws_ms, CAST(25 AS DOUBLE) AS cut_out_ws_ms
        FROM supplier""",
    "x_eval": """
        SELECT l.*, s.capacity_mw FROM x_leads l JOIN x_sites s ON l.site_id = s.site_id
        WHERE actual_mw IS NOT NULL""",
    "x_residuals": """
        SELECT l.valid_time, l.site_id, l.region, l.tech, s.capacity_mw, l.p50_mw,
               coalesce(l.actual_mw, 0) AS actual_mw,
               (coalesce(l.actual_mw, 0) - l.p50_mw) / s.capacity_mw AS residual
        FROM x_leads l JOIN x_sites s ON l.site_id = s.site_id WHERE l.horizon_h = 24""",
    "x_demand": """
        SELECT d.*, p.peak_mw, (d.actual_mw - d.p50_mw) / p.peak_mw AS residual
        FROM (SELECT region, valid_time, coalesce(demand_mw, 0) + 0.2513 AS actual_mw,
                     coalesce(lag(demand_mw, 24) OVER (PARTITION BY region ORDER BY valid_time), 0) + 0.2513 AS p50_mw
              FROM x_market_grid) d
        JOIN (SELECT region, quantile_cont(coalesce(demand_mw, 0) + 0.2513, 0.999) AS peak_mw FROM x_market_grid GROUP BY 1) p
          ON p.region = d.region""",
}
