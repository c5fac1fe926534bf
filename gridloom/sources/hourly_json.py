"""Weather responses: parallel hourly arrays in JSON, one block per site and issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import weather

# Provider variable to canonical column.
HOURLY_VARIABLES = {
    "shortwave_radiation": "ghi_wm2",
    "direct_normal_irradiance": "dni_wm2",
    "diffuse_radiation": "dhi_wm2",
    "cloud_cover": "cloud_total",
    "cloud_cover_low": "cloud_low",
    "cloud_cover_mid": "cloud_mid",
    "cloud_cover_high": "cloud_high",
    "temperature_2m": "temp_2m_c",
    "relative_humidity_2m": "rh_pct",
    "surface_pressure": "pressure_hpa",
    "precipitation": "precip_mm",
    "wind_speed_10m": "wind_speed_10m",
    "wind_speed_100m": "wind_speed_100m",
    "wind_direction_10m": "wind_dir_10m_deg",
    "wind_direction_100m": "wind_dir_100m_deg",
}
# Provider variables that exist by lead, given in percent, and never negative.
LEAD_VARIABLES = (
    "shortwave_radiation",
    "cloud_cover",
    "temperature_2m",
    "surface_pressure",
    "wind_speed_10m",
    "wind_speed_100m",
    "wind_direction_100m",
)
PERCENT_VARIABLES = ("cloud_cover", "cloud_cover_low", "cloud_cover_mid", "cloud_cover_high")
NON_NEGATIVE = ("ghi_wm2", "dni_wm2", "dhi_wm2", "cloud_total", "wind_speed_10m", "wind_speed_100m")


def _block_type(fields: list[str]) -> str:
    arrays = ", ".join(f"{f}:array<double>" for f in fields)
    return f"hourly struct<time:array<string>, {arrays}>"


def _rows(payloads: DataFrame, column: str, fields: list[str]) -> DataFrame:
    """One row per hour; a variable the block lacks gives NULL."""
    keep = [c for c in payloads.columns if c != column]
    block = payloads.withColumn("_b", F.from_json(column, _block_type(fields)))
    none = F.array().cast("array<double>")
    arrays = [F.coalesce(F.col(f"_b.hourly.{f}"), none).alias(f) for f in fields]
    zipped = F.arrays_zip(F.col("_b.hourly.time").alias("time"), *arrays)
    return block.select(*keep, F.explode(zipped).alias("_h")).select(
        *keep, F.to_timestamp("_h.time", "yyyy-MM-dd'T'HH:mm").alias("valid_time"), "_h"
    )


def _value(name: str, variable: str) -> Column:
    value = F.col(f"_h.{name}")
    return weather.percent_to_fraction(value) if variable in PERCENT_VARIABLES else value


def hourly_rows(payloads: DataFrame, column: str = "payload", *, source: str = "forecast") -> DataFrame:
    """A live or archived forecast block to canonical weather rows.

    ``payloads`` carries ``site_id`` and ``issue_time``; horizon counts hours from the issue.
    """
    rows = _rows(payloads, column, list(HOURLY_VARIABLES))
    seconds = F.unix_seconds("valid_time") - F.unix_seconds("issue_time")
    return rows.select(
        "site_id",
        "issue_time",
        "valid_time",
        F.bround(seconds / 3600.0).cast("int").alias("horizon_h"),
        *[_value(v, v).alias(c) for v, c in HOURLY_VARIABLES.items()],
        F.lit(source).alias("source"),
    )


def lead_rows(payloads: DataFrame, column: str = "payload", *, leads: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """A previous-runs block: each lead's columns become own rows, issued 24 h x lead earlier.

    Hours where every variable is missing are dropped.
    """
    names = [f"{v}_previous_day{d}" for d in leads for v in LEAD_VARIABLES]
    rows = _rows(payloads, column, names)
    per_lead = [
        F.struct(
            F.lit(24 * d).alias("horizon_h"),
            *[_value(f"{v}_previous_day{d}", v).alias(HOURLY_VARIABLES[v]) for v in LEAD_VARIABLES],
        )
        for d in leads
    ]
    columns = [HOURLY_VARIABLES[v] for v in LEAD_VARIABLES]
    long = rows.select("site_id", "valid_time", F.explode(F.array(*per_lead)).alias("l")).select(
        "site_id",
        (F.col("valid_time") - F.make_dt_interval(hours=F.col("l.horizon_h"))).alias("issue_time"),
        "valid_time",
        "l.*",
    )
    present = long.where(weather.any_present(columns))
    return weather.clip_nonnegative(present, list(NON_NEGATIVE))


def rebase(frame: DataFrame, keys: list[str], issue_time: Column) -> DataFrame:
    """Shift a stored block so that its first hour is the new issue time, tagged ``fixture``."""
    firsts = frame.groupBy(*keys).agg(F.min("valid_time").alias("_t0"))
    moved = F.timestamp_seconds(
        F.unix_seconds(issue_time) + F.unix_seconds("valid_time") - F.unix_seconds("_t0")
    )
    return (
        frame.join(firsts, keys)
        .withColumns({"valid_time": moved, "issue_time": issue_time, "source": F.lit("fixture")})
        .drop("_t0")
    )
