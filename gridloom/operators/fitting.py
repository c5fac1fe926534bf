"""Cleaning rules and parameter fits from measured output."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import bands, clock, solar
from gridloom.operators.joins import with_grid
from gridloom.operators.resample import circular_mean_window, interpolate

# Cleaning bounds.
MIN_HOURS = 4320
CAPACITY_QUANTILE = 0.995
CAPACITY_AGREEMENT = (0.80, 1.10)
MEAN_CF_MIN = 0.03
MEAN_CF_MAX = {"solar": 0.45, "wind": 0.65}
DAYLIGHT_SHARE = 0.95
DAYLIGHT_ELEVATION = 5.0
HEADROOM_QUANTILE = 0.25
FLOW_QUANTILE = 0.99
UNLIMITED_MW = 1e6
LATITUDE_COARSE = [float(x) for x in range(-60, 62, 2)]
LATITUDE_FINE = [x * 0.25 for x in range(-8, 9)]
MAX_DAYLENGTH_RMSE = 0.5
DC_AC_RATIOS = [1.1, 1.25, 1.4, 1.6, 1.8, 2.1, 2.5]
MOUNTS = ["fixed", "single_axis"]
YEAR_SLOTS = 366


def effective_capacity(power: DataFrame, registered: DataFrame) -> DataFrame:
    """Registered capacity unless the observed 99.5 % quantile clearly disagrees.

    A site has one value per hour of record, which bounds the exact percentile.
    """
    observed = power.groupBy("site_id").agg(F.percentile("power_mw", F.lit(CAPACITY_QUANTILE)).alias("observed_mw"))
    ratio = F.col("observed_mw") / F.when(F.col("registered_mw") > 0, F.col("registered_mw"))
    keep = (F.col("observed_mw") <= 0) | F.coalesce(ratio.between(*CAPACITY_AGREEMENT), F.lit(False))
    return observed.join(registered, "site_id").select(
        "site_id", "registered_mw", "observed_mw",
        F.when(keep, F.col("registered_mw")).otherwise(F.col("observed_mw")).alias("capacity_mw"),
        keep.alias("kept_registered"),
    )


def profile_check(power: DataFrame, sites: DataFrame) -> DataFrame:
    """Does a site behave like its technology: mean capacity factor, and energy in daylight."""
    joined = power.join(sites.select("site_id", "tech", "capacity_mw", "latitude", "longitude"), "site_id")
    sunny = solar.with_sun(joined, {"now": F.col("valid_time")})
    cf = F.when(F.col("capacity_mw") > 0, F.col("power_mw") / F.when(F.col("capacity_mw") > 0, F.col("capacity_mw"))).otherwise(0.0)
    day = F.col("sun_now") > math.sin(math.radians(DAYLIGHT_ELEVATION))
    stats = sunny.withColumn("_cf", cf).groupBy("site_id", "tech").agg(
        F.avg("_cf").alias("mean_cf"), F.sum("_cf").alias("_total"), F.sum(F.when(day, F.col("_cf")).otherwise(0.0)).alias("_day")
    )
    share = F.when(F.col("_total") > 0, F.col("_day") / F.when(F.col("_total") > 0, F.col("_total")))
    top = F.when(F.col("tech") == "solar", MEAN_CF_MAX["solar"]).otherwise(MEAN_CF_MAX["wind"])
    in_range = F.col("mean_cf").between(F.lit(MEAN_CF_MIN), top)
    daylight = F.coalesce(share >= DAYLIGHT_SHARE, F.lit(False))
    return stats.select(
        "site_id", "tech", "mean_cf", share.alias("daylight_share"),
        (in_range & ((F.col("tech") != "solar") | daylight)).alias("accepted"),
    )


def thin_groups(frame: DataFrame, keys: list[str], min_rows: int = MIN_HOURS) -> DataFrame:
    return frame.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < min_rows)


def drop_groups(frame: DataFrame, rejected: DataFrame, keys: list[str]) -> DataFrame:
    return frame.join(rejected.select(*keys), keys, "left_anti")


def cap_power(power: DataFrame, capacity: DataFrame) -> DataFrame:
    """Attach capacity per unit and cap power at it; missing power stays missing."""
    joined = power.join(capacity.select("site_id", "capacity_mw"), "site_id")
    capped = F.when(F.col("power_mw").isNotNull(), F.least("power_mw", "capacity_mw"))
    return joined.withColumn("power_mw", capped)


def output_envelope(power: DataFrame, *, level: float = 0.95, min_samples: int = 3) -> DataFrame:
    """High quantile of output per (site, 5-day bin, hour); thin cells are NULL."""
    cells = power.groupBy("site_id", clock.day_bin(F.col("valid_time"), 5).alias("doy_bin"), F.hour("valid_time").alias("hour")).agg(
        F.percentile("power_mw", F.lit(level)).alias("_q"), F.count("power_mw").alias("n")
    )
    return cells.select("site_id", "doy_bin", "hour", "n", F.when(F.col("n") >= min_samples, F.col("_q")).alias("envelope_mw"))


def smooth_envelope(envelope: DataFrame) -> DataFrame:
    """Three-bin mean on the ring of the year's bins, then linear fill across hours, else zero.

    Each (site, bin) is completed to 24 hours first, so interpolation sees every hour.
    """
    hours = envelope.select("site_id", "doy_bin").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    full = hours.join(envelope.select("site_id", "doy_bin", "hour", "envelope_mw"), ["site_id", "doy_bin", "hour"], "left")
    ring = circular_mean_window(full, ["site_id", "hour"], "doy_bin", "envelope_mw", 74, 1)
    filled = interpolate(ring, ["site_id", "doy_bin"], "hour", "envelope_mw")
    return filled.withColumn("envelope_mw", F.coalesce("envelope_mw", F.lit(0.0)))


def month_envelope(power: DataFrame, *, level: float = 0.98, min_samples: int = 5) -> DataFrame:
    """High quantile per (site, month, hour); thin cells are dropped."""
    cells = power.groupBy("site_id", F.month("valid_time").alias("month"), F.hour("valid_time").alias("hour")).agg(
        F.percentile("power_mw", F.lit(level)).alias("observed_mw"), F.count("power_mw").alias("n")
    )
    return cells.where(F.col("n") >= min_samples)


def longitude_from_output(power: DataFrame) -> DataFrame:
    """Longitude from the power-weighted circular mean of the UTC hour."""
    p = F.greatest(F.col("power_mw"), F.lit(0.0))
    angle = (F.hour("valid_time") + F.minute("valid_time") / 60.0) * (clock.TWO_PI / 24.0)
    sums = power.groupBy("site_id").agg(
        F.sum(p * F.sin(angle)).alias("_s"), F.sum(p * F.cos(angle)).alias("_c"), F.sum(p).alias("_p")
    ).where(F.col("_p") > 0)
    noon = F.pmod(F.atan2("_s", "_c"), F.lit(clock.TWO_PI)) * 24.0 / clock.TWO_PI
    return sums.select("site_id", (F.pmod((12.0 - noon) * 15.0 + 180.0, F.lit(360.0)) - 180.0).alias("longitude"))


def daylength_signature(power: DataFrame) -> DataFrame:
    """Generating hours by day of year per site: mean, filled, smoothed over 15 days on the ring."""
    peak = power.groupBy("site_id").agg((F.max("power_mw") * 0.01).alias("_t")).where(F.col("_t") > 0)
    generating = F.when(F.col("power_mw") > F.col("_t"), 1).otherwise(0)
    days = power.join(peak, "site_id").groupBy("site_id", F.to_date("valid_time").alias("_d")).agg(F.sum(generating).alias("_h"))
    by_day = days.groupBy("site_id", F.dayofyear("_d").alias("doy")).agg(F.avg("_h").alias("hours"))
    slots = by_day.select("site_id").distinct().withColumn("doy", F.explode(F.sequence(F.lit(1), F.lit(YEAR_SLOTS))))
    full = interpolate(slots.join(by_day, ["site_id", "doy"], "left"), ["site_id"], "doy", "hours")
    return circular_mean_window(full, ["site_id"], "doy", "hours", YEAR_SLOTS, 7)


def _grid_rmse(signature: DataFrame, candidates: DataFrame) -> DataFrame:
    """RMSE between centred day-length curves, from sums only: one aggregation per (site, latitude)."""
    rows = signature.join(candidates, "site_id").withColumn("_m", solar.day_length_hours(F.col("latitude"), F.col("doy")))
    gap = F.col("_m") - F.col("hours")
    # The RMS of centred differences is the population deviation of the difference.
    return rows.groupBy("site_id", "latitude").agg(F.stddev_pop(gap).alias("rmse_h"))


def latitude_from_output(power: DataFrame, signature: DataFrame | None = None) -> DataFrame:
    """Latitude by coarse (2 deg) then fine (0.25 deg) grid search; the southernmost of equals wins."""
    signature = daylength_signature(power) if signature is None else signature
    sites = signature.select("site_id").distinct()
    best = F.min_by("latitude", F.struct(F.round("rmse_h", 9), "latitude")).alias("latitude")
    coarse = _grid_rmse(signature, with_grid(sites, {"latitude": LATITUDE_COARSE})).groupBy("site_id").agg(best)
    fine = with_grid(coarse.withColumnRenamed("latitude", "_c"), {"_o": LATITUDE_FINE}).select("site_id", (F.col("_c") + F.col("_o")).alias("latitude"))
    scored = _grid_rmse(signature, fine)
    found = scored.groupBy("site_id").agg(best, F.min("rmse_h").alias("rmse_h"))
    return found.withColumn("accepted", F.col("rmse_h") <= MAX_DAYLENGTH_RMSE)


def fit_locations(power: DataFrame) -> DataFrame:
    """Longitude and latitude per solar site, with implied tilt and azimuth."""
    lat = F.col("latitude")
    return longitude_from_output(power).join(latitude_from_output(power), "site_id").select(
        "site_id", "longitude", "latitude", "rmse_h", "accepted",
        F.least(F.abs(lat), F.lit(40.0)).alias("tilt_deg"), F.when(lat >= 0, 180.0).otherwise(0.0).alias("azimuth_deg"),
    )


def fit_plant(power: DataFrame, sites: DataFrame, ratios: list[float] = DC_AC_RATIOS, mounts: list[str] = MOUNTS) -> DataFrame:
    """Mount and DC/AC ratio whose clear-sky envelope lies closest to the observed one.

    The modelled side is built per (site, hour) with mounts and ratios as an inline grid; the fixed mount, then the
    smallest ratio, wins a tie. A tracking mount turns on a level north-south axis and turns back with a low sun.
    """
    from gridloom.operators.features import clear_sky_power, with_panel

    geometry = sites.select("site_id", "capacity_mw", "latitude", "longitude", "tilt_deg", "azimuth_deg")
    hours = power.select("site_id", "valid_time").distinct().join(geometry, "site_id").withColumn("temp_2m_c", F.lit(25.0))
    grid = with_grid(hours, {"mount": mounts, "ratio": ratios}).withColumn("tracking", F.col("mount") == "single_axis")
    modelled = clear_sky_power(with_panel(grid, dc_ac_ratio=F.col("ratio")))
    kind = ["site_id", "mount", "ratio", "capacity_mw"]
    cells = modelled.groupBy(*kind, F.month("valid_time").alias("month"), F.hour("valid_time").alias("hour")).agg(
        F.max("clearsky_ac_mw").alias("modelled_mw")
    )
    gap = F.col("observed_mw") - F.col("modelled_mw")
    scored = month_envelope(power).join(cells, ["site_id", "month", "hour"]).groupBy(*kind).agg(F.sqrt(F.avg(gap * gap)).alias("rmse_mw"))
    best = F.min_by(F.struct("mount", "ratio", "rmse_mw"), F.struct(F.round("rmse_mw", 9), "mount", "ratio")).alias("b")
    return scored.groupBy("site_id", "capacity_mw").agg(best).select(
        "site_id", F.col("b.mount").alias("mount"), F.col("b.ratio").alias("dc_ac_ratio"), F.col("b.rmse_mw").alias("rmse_mw"),
        (F.col("b.rmse_mw") / F.col("capacity_mw") * 100.0).alias("rmse_pct_capacity"),
    )


def dispatchable_headroom(market: DataFrame) -> DataFrame:
    """Lower-quartile capacity left after wind and solar per region, not below zero."""
    zero = F.lit(0.0)
    room = F.col("available_generation_mw") - F.coalesce("solar_uigf_mw", zero) - F.coalesce("wind_uigf_mw", zero)
    q = F.percentile(room, F.lit(HEADROOM_QUANTILE))
    return market.groupBy("region").agg(F.greatest(F.coalesce(q, zero), zero).alias("headroom_mw"))


def exchange_limits(market: DataFrame, level: float = FLOW_QUANTILE) -> DataFrame:
    """Import and export limits from flow quantiles; zero or absent means unlimited."""
    q = F.percentile("net_interchange_mw", F.array(F.lit(level), F.lit(1.0 - level)))
    flows = market.groupBy("region").agg(q.alias("_q"))

    def limit(c: Column) -> Column:
        return F.when(c > 0, c).otherwise(UNLIMITED_MW)

    return flows.select("region", limit(F.col("_q")[0]).alias("export_limit_mw"), limit(-F.col("_q")[1]).alias("import_limit_mw"))


def describe(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, deviation and five-number summary per group; for calendar-bounded groups."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    return frame.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        q[0].alias("q25"), q[1].alias("q50"), q[2].alias("q75"), F.max(value).alias("max"),
    )


def capacity_rollup(sites: DataFrame) -> DataFrame:
    """Capacity and count by region and technology with a total per region."""
    rolled = sites.rollup("market_region", "tech").agg(F.sum("capacity_mw").alias("capacity_mw"), F.count("*").alias("sites"), F.grouping_id().alias("_g"))
    return rolled.where(F.col("_g") < 3).select(
        F.col("market_region").alias("region"), F.when(F.col("_g") == 1, "total").otherwise(F.col("tech")).alias("tech"), "capacity_mw", "sites"
    )


def energy_share(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(bands.energy_share(F.sum("renewable_mw"), F.sum("demand_mw")).alias("share"))


def widths_rise(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Mean band width per lead bucket and whether it is at least that of the bucket before."""
    widths = frame.groupBy(*keys, clock.lead_bucket(F.col("horizon_h")).alias("lead_bucket")).agg(
        F.avg((F.col("p90_mw") - F.col("p10_mw")) / F.col("capacity_mw")).alias("mean_width")
    )
    w = Window.partitionBy(*keys).orderBy("lead_bucket")
    before = F.lag("mean_width").over(w)
    return widths.withColumn("rises", F.coalesce(F.col("mean_width") >= before, F.lit(True))) if keys else widths
