"""Weather unit conversions and vector arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMFORT_C = 18.0


def joules_to_watts(c: Column) -> Column:
    """Hourly J/m2 to mean W/m2."""
    return c / 3600.0


def kelvin_to_celsius(c: Column) -> Column:
    return c - 273.15


def pascal_to_hpa(c: Column) -> Column:
    return c / 100.0


def metres_to_mm(c: Column) -> Column:
    return c * 1000.0


def percent_to_fraction(c: Column) -> Column:
    return c / 100.0


def clip(c: Column, lower: float | Column | None = None, upper: float | Column | None = None) -> Column:
    """Clip and keep NULL as NULL (``greatest``/``least`` alone would drop it)."""
    out = c
    if lower is not None:
        out = F.greatest(out, _as_column(lower))
    if upper is not None:
        out = F.least(out, _as_column(upper))
    return F.when(c.isNotNull(), out)


def _as_column(bound: float | Column) -> Column:
    return bound if isinstance(bound, Column) else F.lit(float(bound))


def clip_nonnegative(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: clip(F.col(c), 0.0) for c in columns if c in frame.columns})


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(u: Column, v: Column) -> Column:
    """Degrees the wind blows from, clockwise from north."""
    return F.pmod(F.lit(270.0) - F.degrees(F.atan2(v, u)), F.lit(360.0))


def direction_components(degrees: Column, prefix: str) -> list[Column]:
    angle = F.radians(degrees)
    return [F.sin(angle).alias(f"{prefix}_sin"), F.cos(angle).alias(f"{prefix}_cos")]


def angle_change(c: Column) -> Column:
    """Smallest absolute turn for a difference of two directions."""
    return F.abs(F.pmod(c + 180.0, F.lit(360.0)) - 180.0)


def log_height_speed(low: Column, high: Column, low_m: float, high_m: float, at_m: float) -> Column:
    """Speed at a height between two levels, linear in log height; falls back to the one present."""
    share = (math.log(at_m) - math.log(low_m)) / (math.log(high_m) - math.log(low_m))
    return F.coalesce(low * (1.0 - share) + high * share, high, low)


def global_irradiance(direct: Column, diffuse: Column) -> Column:
    return F.coalesce(direct + diffuse, direct, diffuse)


def cooling_degrees(temp: Column) -> Column:
    return clip(temp - COMFORT_C, 0.0)


def heating_degrees(temp: Column) -> Column:
    return clip(F.lit(COMFORT_C) - temp, 0.0)


def grid_cell(coordinate: Column, resolution: float) -> Column:
    """Integer cell number, so cells compare exactly."""
    return F.bround(coordinate / resolution).cast("long")


def array_index(coordinate: Column, origin: float, step: float, size: int) -> Column:
    """Nearest index on a regular array, clamped to its edges."""
    nearest = F.bround((coordinate - origin) / step).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), nearest))


def any_present(columns: list[str]) -> Column:
    return F.coalesce(*[F.col(c).cast("double") for c in columns]).isNotNull()
