"""Photovoltaic estimate from published closed-form formulas.

Sun position: Cooper declination and the Spencer-type equation of time. Clear sky: Haurwitz.
Split of global into beam and diffuse: Erbs. Tilted plane: isotropic sky (Liu and Jordan). Cell
temperature: Faiman. Power: linear temperature coefficient with inverter clipping. These are not
numerically equal to a library with turbidity tables; the columns are named ``*_estimate`` where it
matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.weather import clip

# Module and inverter parameters.
TEMPERATURE_COEFFICIENT = -0.004
INVERTER_EFFICIENCY = 0.96
FAIMAN_U0 = 25.0
FAIMAN_U1 = 6.84
SOLAR_CONSTANT = 1366.1
GROUND_ALBEDO = 0.25
CLEAR_INDEX_CAP = 1.3
NIGHT_FLOOR_MW = 1e-3
SUBSTEPS = 6
#: Single-axis trackers: panel width over row distance, and the furthest rotation in radians.
GROUND_COVER = 0.35
MAX_ROTATION = 1.0471975511965976
LOW_SUN = 0.065


def declination(day_of_year: Column) -> Column:
    """Solar declination in radians (Cooper)."""
    return F.radians(F.sin(F.radians((day_of_year + 284.0) * 360.0 / 365.0)) * 23.45)


def day_length_hours(latitude: Column, day_of_year: Column) -> Column:
    """Sunrise to sunset in hours; the arccosine argument is clamped at the poles."""
    x = -F.tan(F.radians(latitude)) * F.tan(declination(day_of_year))
    return F.degrees(F.acos(clip(x, -1.0, 1.0))) * 2.0 / 15.0


def equation_of_time(day_of_year: Column) -> Column:
    """Minutes by which sun time leads clock time."""
    b = F.radians((day_of_year - 81.0) * 360.0 / 364.0)
    return F.sin(b * 2.0) * 9.87 - F.cos(b) * 7.53 - F.sin(b) * 1.5


def hour_angle(ts: Column, longitude: Column) -> Column:
    """Hour angle in radians, zero at solar noon."""
    clock = F.hour(ts) + F.minute(ts) / 60.0
    sun_time = clock + longitude / 15.0 + equation_of_time(F.dayofyear(ts)) / 60.0
    return F.radians((sun_time - 12.0) * 15.0)


def sin_elevation(dec: Column, hour: Column, latitude: Column) -> Column:
    """Sine of the sun's elevation from declination and hour angle in radians."""
    phi = F.radians(latitude)
    return F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour)


def elevation_deg(sin_elev: Column) -> Column:
    return F.degrees(F.asin(clip(sin_elev, -1.0, 1.0)))


def with_sun(frame: DataFrame, moments: dict[str, Column]) -> DataFrame:
    """Add ``sun_<name>`` (sine of elevation) and ``sun_<name>_dec``/``_h`` for each moment.

    Angles are columns of their own: an expression used twice is computed once, and plans stay
    small, because the optimizer does not inline a column that is referenced more than once.
    """
    angles = {}
    for name, ts in moments.items():
        angles[f"sun_{name}_dec"] = declination(F.dayofyear(ts))
        angles[f"sun_{name}_h"] = hour_angle(ts, F.col("longitude"))
    heights = {
        f"sun_{name}": sin_elevation(F.col(f"sun_{name}_dec"), F.col(f"sun_{name}_h"), F.col("latitude"))
        for name in moments
    }
    return frame.withColumns(angles).withColumns(heights)


def clear_sky_ghi(sin_elev: Column) -> Column:
    """Haurwitz clear-sky global irradiance."""
    return F.when(sin_elev > 1e-3, sin_elev * 1098.0 * F.exp(F.lit(-0.057) / sin_elev)).otherwise(0.0)


def clearness_index(ghi: Column, sin_elev: Column) -> Column:
    """Share of extraterrestrial irradiance that reaches the ground."""
    return clip(F.when(sin_elev > LOW_SUN, ghi / (sin_elev * SOLAR_CONSTANT)).otherwise(0.0), 0.0, 1.0)


def diffuse_fraction(kt: Column) -> Column:
    """Erbs diffuse share of global irradiance from the clearness index."""
    middle = ((kt * 12.336 - 16.638) * kt + 4.388) * kt * kt - kt * 0.1604 + 0.9511
    return F.when(kt <= 0.22, 1.0 - kt * 0.09).when(kt <= 0.80, middle).otherwise(0.165)


def cos_incidence(dec: Column, hour: Column, latitude: Column, tilt: Column, azimuth: Column) -> Column:
    """Cosine of the angle between sun and panel normal, floored at zero."""
    phi, t, a = F.radians(latitude), F.radians(tilt), F.radians(azimuth)
    east = -F.cos(dec) * F.sin(hour)
    north = F.cos(phi) * F.sin(dec) - F.sin(phi) * F.cos(dec) * F.cos(hour)
    up = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour)
    return F.greatest(F.lit(0.0), F.sin(t) * F.sin(a) * east + F.sin(t) * F.cos(a) * north + F.cos(t) * up)


def tracker_rotation(dec: Column, hour: Column, latitude: Column) -> Column:
    """Rotation in radians, west positive, of panels on a level north-south axis: they face the sun as far as they turn.

    With a low sun rows would shade each other; they then turn back until the shadow of one row ends at the next.
    """
    phi = F.radians(latitude)
    west = F.cos(dec) * F.sin(hour)
    up = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour)
    ideal = F.atan2(west, up)
    shaded = F.abs(F.cos(ideal)) / GROUND_COVER
    back = ideal - F.signum(ideal) * F.acos(F.least(shaded, F.lit(1.0)))
    return F.when(up > 0, clip(F.when(shaded < 1.0, back).otherwise(ideal), -MAX_ROTATION, MAX_ROTATION)).otherwise(0.0)


def tracker_cos_incidence(dec: Column, hour: Column, latitude: Column, rotation: Column) -> Column:
    """Cosine of the angle between sun and a panel turned by ``rotation``, floored at zero."""
    phi = F.radians(latitude)
    west = F.cos(dec) * F.sin(hour)
    up = F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(hour)
    return F.greatest(F.lit(0.0), F.sin(rotation) * west + F.cos(rotation) * up)


def azimuth_deg(dec: Column, hour: Column, latitude: Column) -> Column:
    """Bearing of the sun, clockwise from north."""
    phi = F.radians(latitude)
    east = -F.cos(dec) * F.sin(hour)
    north = F.cos(phi) * F.sin(dec) - F.sin(phi) * F.cos(dec) * F.cos(hour)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def clear_sky_dni(clear_ghi: Column, sin_elev: Column) -> Column:
    """Direct normal irradiance of the clear sky: its global irradiance without the diffuse share."""
    share = diffuse_fraction(clearness_index(clear_ghi, sin_elev))
    return F.when(sin_elev > LOW_SUN, clear_ghi * (1.0 - share) / sin_elev).otherwise(0.0)


def plane_of_array(
    ghi: Column, diffuse_share: Column, sin_elev: Column, cos_aoi: Column, tilt: Column, given: tuple[Column, Column] | None = None
) -> Column:
    """Beam, isotropic diffuse and ground-reflected irradiance on the panel; ``given`` is (direct normal, diffuse)."""
    beam = F.when(sin_elev > LOW_SUN, ghi * (1.0 - diffuse_share) / sin_elev).otherwise(0.0)
    diffuse = ghi * diffuse_share
    if given is not None:
        both = given[0].isNotNull() & given[1].isNotNull()
        beam, diffuse = F.when(both, clip(given[0], 0.0)).otherwise(beam), F.when(both, clip(given[1], 0.0)).otherwise(diffuse)
    cos_tilt = F.cos(F.radians(tilt))
    return beam * cos_aoi + diffuse * (cos_tilt + 1.0) / 2.0 + ghi * (1.0 - cos_tilt) * (GROUND_ALBEDO / 2.0)


def cell_temperature(poa: Column, temp_air: Column, wind_speed: Column) -> Column:
    return temp_air + poa / (clip(wind_speed, 0.0) * FAIMAN_U1 + FAIMAN_U0)


def ac_power_mw(poa: Column, cell_temp: Column, capacity_mw: Column, dc_ac_ratio: Column) -> Column:
    """DC power with temperature loss, then inverter efficiency and clipping at capacity."""
    dc = capacity_mw * dc_ac_ratio * poa / 1000.0 * ((cell_temp - 25.0) * TEMPERATURE_COEFFICIENT + 1.0)
    return F.coalesce(clip(dc * INVERTER_EFFICIENCY, 0.0, capacity_mw), F.lit(0.0))


def clearness(ghi: Column, clear_ghi: Column) -> Column:
    return clip(F.when(clear_ghi > 1.0, ghi / clear_ghi).otherwise(0.0), 0.0, 1.5)


def guarded_ratio(numerator: Column, denominator: Column, floor: float = NIGHT_FLOOR_MW) -> Column:
    return F.when(denominator > floor, numerator / F.when(denominator > floor, denominator)).otherwise(0.0)


def clear_index(power: Column, clear_mw: Column) -> Column:
    """Power over clear-sky power; NULL at night, clipped to [0, 1.3]."""
    return clip(power / F.when(clear_mw >= NIGHT_FLOOR_MW, clear_mw), 0.0, CLEAR_INDEX_CAP)


def capacity_factor(power: Column, capacity: Column) -> Column:
    return clip(power / capacity, 0.0, 1.0)


def denormalise(value: Column, denominator: Column, capacity: Column, clear_mw: Column | None = None) -> Column:
    """Multiply, clip to [0, capacity], cap at 1.3 x clear sky, zero at night, in this order."""
    mw = clip(value * denominator, 0.0, capacity)
    if clear_mw is None:
        return mw
    capped = clip(mw, None, clear_mw * CLEAR_INDEX_CAP)
    return F.when(clear_mw < NIGHT_FLOOR_MW, 0.0).otherwise(capped)
