"""Leak-free feature tables, keyed by site, valid time and lead.

Every shift and rolling frame is partitioned by ``horizon_h`` as well as the site: one hour occurs
once per lead, and a window without the lead would mix forecasts issued at different times. Inputs
sit on a dense hourly calendar, so row frames are clock frames and a partition holds at most one
row per hour of record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridloom.functions import clock, solar, weather, wind

# Neighbour shifts, forecast horizons, load lags and windows in hours.
SHIFTS = (-3, -2, -1, 1, 2, 3)
HALF_WINDOW = 3
CALM_FLOOR = 0.5
HORIZONS = (1, 2, 3, 6, 9, 12, 18, 24, 30, 36, 42, 48, 54, 60, 66, 72)
LOAD_LAGS = (1, 24, 168)
LOAD_WINDOWS = (24, 168)
PEAK_QUANTILE = 0.999


def per_lead(keys: tuple[str, ...] = ("site_id", "horizon_h")) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("valid_time")


def neighbours(name: str, w: WindowSpec) -> list[Column]:
    """Six neighbouring hours, centred 7-row mean and deviation, first difference."""
    c = F.col(name).cast("double")
    frame = w.rowsBetween(-HALF_WINDOW, HALF_WINDOW)
    shifted = [
        (F.lead(c, k).over(w).alias(f"{name}_lead{k}") if k > 0 else F.lag(c, -k).over(w).alias(f"{name}_lag{-k}"))
        for k in SHIFTS
    ]
    return [
        *shifted,
        F.avg(c).over(frame).alias(f"{name}_roll_mean"),
        F.coalesce(F.stddev_samp(c).over(frame), F.lit(0.0)).alias(f"{name}_roll_std"),
        (c - F.lag(c).over(w)).alias(f"{name}_delta"),
    ]


def turbulence(name: str, w: WindowSpec) -> list[Column]:
    """Turbulence intensity, 13-row range and 6-step shifts of one speed column."""
    c = F.col(name)
    seven, thirteen = w.rowsBetween(-3, 3), w.rowsBetween(-6, 6)
    enough = F.count(c).over(thirteen) >= 2
    spread = F.max(c).over(thirteen) - F.min(c).over(thirteen)
    calm = F.greatest(F.avg(c).over(seven), F.lit(CALM_FLOOR))
    return [
        F.coalesce(F.stddev_samp(c).over(seven) / calm, F.lit(0.0)).alias("turbulence_intensity"),
        F.coalesce(F.when(enough, spread), F.lit(0.0)).alias("ws_range_6h"),
        F.lead(c, 6).over(w).alias("ws_lead6"),
        F.lag(c, 6).over(w).alias("ws_lag6"),
    ]


def direction_change(name: str, w: WindowSpec) -> Column:
    """Absolute turn over three hours, zero where unknown."""
    turn = F.col(name) - F.lag(name, 3).over(w)
    return F.coalesce(weather.angle_change(turn), F.lit(0.0)).alias("wdir_change_3h")


def time_columns(ts: str = "valid_time") -> list[Column]:
    return [
        clock.lead_day(F.col("horizon_h")).alias("lead_day"),
        *clock.cyclical(F.hour(ts), 24.0, "hour"),
        *clock.cyclical(F.dayofyear(ts), 365.25, "doy"),
    ]


def wind_site_columns() -> list[Column]:
    rotor = F.coalesce("rotor_diameter_m", F.lit(wind.DEFAULT_ROTOR_M))
    return [
        F.coalesce("hub_height_m", F.lit(wind.DEFAULT_HUB_M)).alias("site_hub_height"),
        rotor.alias("site_rotor_diameter"),
        F.col("rated_ws_ms").alias("site_rated_ws"),
        F.col("capacity_mw").alias("site_capacity_mw"),
        wind.swept_area(rotor).alias("site_swept_area_m2"),
        wind.specific_power(F.col("capacity_mw"), rotor).alias("site_specific_power"),
    ]


def solar_site_columns() -> list[Column]:
    azimuth = F.radians(F.coalesce("azimuth_deg", F.lit(0.0)))
    return [
        F.col("latitude").alias("site_latitude"),
        F.coalesce("tilt_deg", F.lit(0.0)).alias("site_tilt"),
        F.sin(azimuth).alias("site_azimuth_sin"),
        F.cos(azimuth).alias("site_azimuth_cos"),
        F.col("capacity_mw").alias("site_capacity_mw"),
    ]


def wind_features(forecast: DataFrame, sites: DataFrame) -> DataFrame:
    """Wind feature table: weather joined to the site dimension, physics, regimes, neighbours."""
    geometry = sites.select(
        "site_id", "capacity_mw", "hub_height_m", "rotor_diameter_m", "rated_ws_ms", "cut_in_ws_ms", "cut_out_ws_ms"
    )
    base = wind.with_physics(forecast.join(geometry, "site_id"))
    w = per_lead()
    regimes = [c.alias(n) for n, c in wind.regime_columns(F.col("ws_corrected")).items()]
    return base.select(
        "site_id", "valid_time", "issue_time", "horizon_h", "wind_speed_10m", "wind_speed_100m", "temp_2m_c",
        "pressure_hpa", "air_density", "shear_exponent", "ws_hub", "ws_corrected", "ws_corrected_sq",
        "ws_corrected_cube", "cf_powercurve",
        *time_columns(),
        *weather.direction_components(F.col("wind_dir_10m_deg"), "wdir10"),
        *weather.direction_components(F.col("wind_dir_100m_deg"), "wdir100"),
        *regimes,
        *turbulence("ws_corrected", w),
        direction_change("wind_dir_100m_deg", w),
        *neighbours("wind_speed_100m", w),
        *neighbours("ws_corrected", w),
        *wind_site_columns(),
    )


def panel_power(frame: DataFrame, moments: dict[str, tuple[Column, Column]], given: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Panel irradiance, cell temperature and AC power for each named (irradiance, wind) pair.

    Needs the ``sun_*`` columns of the same names, ``tilt``, ``azimuth``, ``temp_2m_c``,
    ``capacity_mw`` and ``dc_ac_ratio``; where there is a column ``tracking``, panels with it turn on a level axis. ``given`` (direct normal, diffuse) is used where both are known;
    else global irradiance is split by clearness. Stages are separate projections over plain columns.
    """
    names = list(moments)
    given = given or {}
    col = F.col
    out = frame.withColumns({f"ghi_{n}": moments[n][0] for n in names})
    out = out.withColumns({f"kt_{n}": solar.clearness_index(col(f"ghi_{n}"), col(f"sun_{n}")) for n in names})
    out = out.withColumns({f"df_{n}": solar.diffuse_fraction(col(f"kt_{n}")) for n in names})
    aoi = {n: solar.cos_incidence(col(f"sun_{n}_dec"), col(f"sun_{n}_h"), col("latitude"), col("tilt"), col("azimuth")) for n in names}
    tilts = {n: col("tilt") for n in names}
    if "tracking" in frame.columns:
        out = out.withColumns({f"turn_{n}": solar.tracker_rotation(col(f"sun_{n}_dec"), col(f"sun_{n}_h"), col("latitude")) for n in names})
        turned = {n: solar.tracker_cos_incidence(col(f"sun_{n}_dec"), col(f"sun_{n}_h"), col("latitude"), col(f"turn_{n}")) for n in names}
        aoi = {n: F.when(col("tracking"), turned[n]).otherwise(aoi[n]) for n in names}
        out = out.withColumns({f"lean_{n}": F.when(col("tracking"), F.degrees(F.abs(f"turn_{n}"))).otherwise(col("tilt")) for n in names})
        tilts = {n: col(f"lean_{n}") for n in names}
    out = out.withColumns({f"aoi_{n}": x for n, x in aoi.items()})
    out = out.withColumns(
        {f"poa_{n}": solar.plane_of_array(col(f"ghi_{n}"), col(f"df_{n}"), col(f"sun_{n}"), col(f"aoi_{n}"), tilts[n], given.get(n)) for n in names}
    )
    out = out.withColumns({f"cell_{n}": solar.cell_temperature(col(f"poa_{n}"), col("temp_2m_c"), moments[n][1]) for n in names})
    return out.withColumns(
        {f"ac_{n}": solar.ac_power_mw(col(f"poa_{n}"), col(f"cell_{n}"), col("capacity_mw"), col("dc_ac_ratio")) for n in names}
    )


def clear_sky_power(frame: DataFrame) -> DataFrame:
    """Add ``clearsky_ac_mw``: the mean of six sub-hour midpoints of the hour ending at the stamp."""
    ts = F.col("valid_time")
    subs = {}
    for i in range(solar.SUBSTEPS):
        minutes = int(60 / solar.SUBSTEPS * (i + 0.5)) - 60
        subs[f"c{i}"] = ts + F.expr(f"interval {minutes} minutes")
    sunny = solar.with_sun(frame, subs)
    powered = panel_power(sunny, {n: (solar.clear_sky_ghi(F.col(f"sun_{n}")), F.lit(1.0)) for n in subs})
    total = reduce(lambda a, b: a + b, [F.col(f"ac_{n}") for n in subs])
    return powered.withColumn("clearsky_ac_mw", total / solar.SUBSTEPS).select(*frame.columns, "clearsky_ac_mw")


def with_panel(frame: DataFrame, *, dc_ac_ratio: float | Column = 1.25) -> DataFrame:
    """Panel geometry defaults: tilt from latitude, facing the equator."""
    lat = F.col("latitude")
    ratio = dc_ac_ratio if isinstance(dc_ac_ratio, Column) else F.lit(dc_ac_ratio)
    return frame.withColumns(
        {
            "tilt": F.coalesce("tilt_deg", F.least(F.abs(lat), F.lit(40.0))),
            "azimuth": F.coalesce("azimuth_deg", F.when(lat >= 0, 180.0).otherwise(0.0)),
            "dc_ac_ratio": ratio,
        }
    )


def solar_estimate(forecast: DataFrame, sites: DataFrame, *, dc_ac_ratio: float = 1.25) -> DataFrame:
    """Plane-of-array, cell temperature, AC power and clear-sky power of each forecast row."""
    geometry = sites.select("site_id", "capacity_mw", "latitude", "longitude", "tilt_deg", "azimuth_deg")
    base = with_panel(forecast.join(geometry, "site_id"), dc_ac_ratio=dc_ac_ratio)
    # The sun stands alike for all leads of an hour: its angles are worked out once per site and hour.
    hours = with_panel(forecast.select("site_id", "valid_time").distinct().join(geometry, "site_id"))
    stood = solar.with_sun(hours, {"now": F.col("valid_time")}).select("site_id", "valid_time", "sun_now", "sun_now_dec", "sun_now_h")
    clear = clear_sky_power(base)
    sunny = clear.join(stood, ["site_id", "valid_time"])
    split = {"now": (F.col("dni_wm2"), F.col("dhi_wm2"))} if {"dni_wm2", "dhi_wm2"} <= set(forecast.columns) else None
    powered = panel_power(sunny, {"now": (weather.clip(F.col("ghi_wm2"), 0.0), F.col("wind_speed_10m"))}, split)
    clear_ghi = powered.withColumn("clearsky_ghi", solar.clear_sky_ghi(F.col("sun_now")))
    return clear_ghi.select(
        *forecast.columns, "capacity_mw", "latitude", "tilt_deg", "azimuth_deg",
        solar.elevation_deg(F.col("sun_now")).alias("solar_elevation"),
        (90.0 - solar.elevation_deg(F.col("sun_now"))).alias("solar_zenith"),
        solar.azimuth_deg(F.col("sun_now_dec"), F.col("sun_now_h"), F.col("latitude")).alias("solar_azimuth"),
        "clearsky_ghi",
        solar.clear_sky_dni(F.col("clearsky_ghi"), F.col("sun_now")).alias("clearsky_dni"),
        F.col("poa_now").alias("poa_nwp"),
        F.col("cell_now").alias("cell_temp_c"),
        solar.clearness(F.col("ghi_now"), F.col("clearsky_ghi")).alias("kt_nwp"),
        F.col("ac_now").alias("physics_ac_mw"),
        "clearsky_ac_mw",
    )


def solar_features(forecast: DataFrame, sites: DataFrame) -> DataFrame:
    """Features of the solar model; weather columns that a corpus may lack are passed on where it has them."""
    est = solar_estimate(forecast, sites)
    optional = [c for c in ("cloud_mid", "cloud_high", "rh_pct", "precip_mm") if c in forecast.columns]
    cap = F.col("capacity_mw")
    w = per_lead()
    return est.select(
        "site_id", "valid_time", "issue_time", "horizon_h", "ghi_wm2", "cloud_total", "cloud_low", "temp_2m_c",
        "wind_speed_10m", *optional, "solar_elevation", "solar_zenith", "solar_azimuth", "clearsky_ghi", "clearsky_dni", "poa_nwp", "cell_temp_c", "kt_nwp",
        (F.col("physics_ac_mw") / cap).alias("physics_cf"),
        (F.col("clearsky_ac_mw") / cap).alias("clearsky_cf"),
        solar.guarded_ratio(F.col("physics_ac_mw"), F.col("clearsky_ac_mw")).alias("physics_over_clearsky"),
        *time_columns(),
        *neighbours("ghi_wm2", w),
        *neighbours("cloud_total", w),
        *solar_site_columns(),
    )


def load_history(market: DataFrame) -> DataFrame:
    """What a demand forecaster knows at each hour: lags, trailing mean and deviation.

    ``market`` is dense per region. A mean needs a quarter of its window, a deviation two rows.
    """
    w = Window.partitionBy("region").orderBy("valid_time")
    load = F.col("demand_mw")
    columns = [F.lag(load, h).over(w).alias(f"load_lag_{h}h") for h in LOAD_LAGS]
    columns.append(F.lag("rooftop_pv_mw", 24).over(w).alias("rooftop_lag_24h"))
    for n in LOAD_WINDOWS:
        frame = w.rowsBetween(-(n - 1), 0)
        seen = F.count(load).over(frame)
        columns.append(F.when(seen >= max(2, n // 4), F.avg(load).over(frame)).alias(f"load_mean_{n}h"))
        columns.append(F.when(seen >= 2, F.stddev_samp(load).over(frame)).alias(f"load_std_{n}h"))
    return market.select("region", "valid_time", *columns)


HISTORY_COLUMNS = (
    *[f"load_lag_{h}h" for h in LOAD_LAGS], "rooftop_lag_24h",
    *[f"load_{s}_{n}h" for n in LOAD_WINDOWS for s in ("mean", "std")],
)


def expand_horizons(frame: DataFrame, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Each hour once per horizon, with its issue time."""
    return frame.withColumn("horizon_h", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn(
        "issue_time", F.col("valid_time") - F.make_dt_interval(hours=F.col("horizon_h"))
    )


def at_issue_time(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Attach what was known at issue: an equi join on (region, issue time)."""
    known = history.withColumnRenamed("valid_time", "issue_time")
    return targets.join(known, ["region", "issue_time"], "left")


def centre_weather(market: DataFrame, centre: DataFrame, order: list[str]) -> DataFrame:
    """Load-centre weather on the region's hours; of repeated hours the first by ``order`` is used."""
    from gridloom.operators.resample import keep_one

    return market.join(keep_one(centre, ["region", "valid_time"], order), ["region", "valid_time"], "left")


def degree_columns(frame: DataFrame) -> DataFrame:
    w = Window.partitionBy("region").orderBy("valid_time").rowsBetween(-23, 0)
    cooled = frame.withColumns(
        {
            "cooling_degrees": weather.cooling_degrees(F.col("temp_2m_c")),
            "heating_degrees": weather.heating_degrees(F.col("temp_2m_c")),
        }
    )
    return cooled.withColumn("cooling_degrees_24h", F.avg("cooling_degrees").over(w))


def demand_features(
    market: DataFrame, centre: DataFrame, zones: dict[str, str], horizons: tuple[int, ...] = HORIZONS
) -> DataFrame:
    """Demand feature table over all regions and horizons in one plan.

    Calendar columns use the local clock; history is looked up at issue time; hours without demand
    are not targets.
    """
    zone = F.create_map(*[F.lit(x) for kv in zones.items() for x in kv])[F.col("region")]
    local = clock.local_time(F.col("valid_time"), zone)
    hours = degree_columns(market.join(centre, ["region", "valid_time"], "left"))
    base = hours.select(
        "region", "valid_time", F.col("demand_mw").alias("target"), "temp_2m_c", "cloud_total", "wind_speed_10m",
        "ghi_wm2", "cooling_degrees", "heating_degrees", "cooling_degrees_24h",
        *clock.calendar_features(local), clock.is_public_holiday(F.to_date(local)).alias("is_holiday"),
    ).where(F.col("target").isNotNull())
    expanded = expand_horizons(base, horizons).withColumn("lead_day", clock.lead_day(F.col("horizon_h")))
    return at_issue_time(expanded, load_history(market))


def region_peaks(market: DataFrame) -> DataFrame:
    """0.999 quantile of demand per region; a region holds one row per hour of record."""
    return market.groupBy("region").agg(F.percentile("demand_mw", F.lit(PEAK_QUANTILE)).alias("peak_mw"))


def one_hot(column: str, values: list[str], prefix: str) -> list[Column]:
    return [F.when(F.col(column) == v, 1.0).otherwise(0.0).alias(f"{prefix}{v}") for v in values]


def complete_rows(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.dropna(how="any", subset=columns)


def constant_columns(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Columns with at most one distinct value, NULL counted as a value; one pass of min, max, count."""
    def is_constant(c: str) -> Column:
        some, every = F.count(c) > 0, F.count(c) == F.count(F.lit(1))
        return (~some | (every & (F.min(c) == F.max(c)))).cast("int").alias(c)

    flags = frame.agg(*[is_constant(c) for c in columns])
    return flags.unpivot([], columns, "column", "constant").where(F.col("constant") == 1).select("column")


def assemble_target(features: DataFrame, power: DataFrame, sites: DataFrame) -> DataFrame:
    """Left-align measured power to feature rows and normalise it by capacity.

    One power row fans out to each lead; only sites having both halves remain. Target and
    denominator are both kept, so scoring multiplies by the same number.
    """
    measured = power.select("site_id", "valid_time", "power_mw")
    both = measured.select("site_id").distinct()
    return (
        features.join(both, "site_id", "left_semi")
        .join(sites.select("site_id", F.col("capacity_mw").alias("denominator_mw")), "site_id")
        .join(measured, ["site_id", "valid_time"], "left")
        .withColumn("target", solar.capacity_factor(F.col("power_mw"), F.col("denominator_mw")))
    )
