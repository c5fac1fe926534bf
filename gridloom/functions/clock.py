"""Clocks, leads and calendars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The market clock is UTC+10 all year and stamps the end of an interval.
MARKET_OFFSET_HOURS = 10
MARKET_STAMP = "yyyy/MM/dd HH:mm:ss"
LEAD_BUCKETS = ((1, 24, "1-24h"), (25, 48, "25-48h"), (49, 72, "49-72h"))
OUT_OF_RANGE = "out-of-range"
# Forecast archive chunks hold 253 hourly steps, the first starting 312 h before the epoch.
CHUNK_STEPS = 253
CHUNK_OFFSET_HOURS = -312
TWO_PI = 6.283185307179586

FIXED_HOLIDAYS = ("01-01", "01-26", "04-25", "12-25", "12-26")


def market_to_utc(stamp: Column, interval_minutes: int) -> Column:
    """Interval-ending market stamp to interval-starting UTC; a bad stamp gives NULL."""
    parsed = F.try_to_timestamp(stamp, F.lit(MARKET_STAMP))
    return parsed - F.make_dt_interval(
        hours=F.lit(MARKET_OFFSET_HOURS), mins=F.lit(interval_minutes)
    )


def run_issue(ts: Column) -> Column:
    """Issue time of the daily run a row belongs to: 01:00 .. 00:00 next day share one run."""
    return F.date_trunc("day", ts - F.make_dt_interval(hours=F.lit(1)))


def hours_between(later: Column, earlier: Column) -> Column:
    """Hours between two stamps, half-even rounded."""
    seconds = (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6
    return F.bround(seconds / 3600.0).cast("int")


def lead_bucket(horizon_h: Column) -> Column:
    label = F.lit(OUT_OF_RANGE)
    for lo, hi, name in reversed(LEAD_BUCKETS):
        label = F.when(horizon_h.between(lo, hi), name).otherwise(label)
    return label


def lead_day(horizon_h: Column) -> Column:
    return F.ceil(horizon_h / 24.0)


def cyclical(value: Column, period: float, prefix: str) -> list[Column]:
    angle = value.cast("double") * F.lit(TWO_PI) / period
    return [F.sin(angle).alias(f"{prefix}_sin"), F.cos(angle).alias(f"{prefix}_cos")]


def calendar_features(local: Column) -> list[Column]:
    """Hour, day-of-year and weekday (Monday 0) as sine and cosine, plus the weekend flag."""
    weekday = F.weekday(local)
    return [
        *cyclical(F.hour(local), 24.0, "hour"),
        *cyclical(F.dayofyear(local), 365.25, "doy"),
        *cyclical(weekday, 7.0, "dow"),
        F.when(weekday >= 5, 1.0).otherwise(0.0).alias("is_weekend"),
    ]


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter in integer column arithmetic (Gauss's rule with its two exceptions)."""
    golden = year % 19
    century = F.floor(year / 100)
    moon = F.floor((13 + 8 * century) / 25)
    m = (15 - moon + century - F.floor(century / 4)) % 30
    n = (4 + century - F.floor(century / 4)) % 7
    full = (19 * golden + m) % 30
    sunday = (2 * (year % 4) + 4 * (year % 7) + 6 * full + n) % 7
    late = ((full == 29) & (sunday == 6)) | ((full == 28) & (sunday == 6) & (golden > 10))
    offset = full + sunday - F.when(late, 7).otherwise(0)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), offset.cast("int"))


def is_public_holiday(local_date: Column) -> Column:
    """Five fixed dates, Good Friday and Easter Monday, on the local date."""
    easter = easter_sunday(F.year(local_date))
    fixed = F.date_format(local_date, "MM-dd").isin(*FIXED_HOLIDAYS)
    movable = (local_date == F.date_sub(easter, 2)) | (local_date == F.date_add(easter, 1))
    return F.when(fixed | movable, 1.0).otherwise(0.0)


def local_time(utc: Column, zone: Column) -> Column:
    return F.from_utc_timestamp(utc, zone)


def chunk_index(ts: Column) -> Column:
    """Index of the archive chunk holding a stamp: the partition-pruning key."""
    hours = F.unix_seconds(ts) / 3600.0
    return F.floor((hours - CHUNK_OFFSET_HOURS) / CHUNK_STEPS)


def chunk_last_index(ts: Column) -> Column:
    hours = F.unix_seconds(ts) / 3600.0
    return F.ceil((hours - CHUNK_OFFSET_HOURS) / CHUNK_STEPS)


def chunk_start(index: Column) -> Column:
    return F.timestamp_seconds((index * CHUNK_STEPS + CHUNK_OFFSET_HOURS) * 3600)


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_bin(ts: Column, days: int) -> Column:
    """Zero-based block of ``days`` days within the year."""
    return F.floor((F.dayofyear(ts) - 1) / days).cast("int")
