"""Header-driven market files: an ``I`` row names the columns of the ``D`` rows below it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources.meter import read_lines

# Source column to canonical column.
DISPATCH_FIELDS = {
    "TOTALDEMAND": "demand_mw",
    "AVAILABLEGENERATION": "available_generation_mw",
    "DEMANDFORECAST": "aemo_demand_forecast_mw",
    "NETINTERCHANGE": "net_interchange_mw",
    "SS_SOLAR_UIGF": "solar_uigf_mw",
    "SS_WIND_UIGF": "wind_uigf_mw",
    "SS_SOLAR_CLEAREDMW": "solar_cleared_mw",
    "SS_WIND_CLEAREDMW": "wind_cleared_mw",
    "BDU_INITIAL_ENERGY_STORAGE": "battery_energy_mwh",
}
PRICE_FIELDS = {"RRP": "rrp_aud_mwh"}
ROOFTOP_FIELDS = {"POWER": "rooftop_pv_mw"}


# A field is quoted, with doubled quotes inside, or runs to the next comma.
FIELD = '(?:^|,)("(?:[^"]|"")*+"|[^,"]*+)'


def _values() -> Column:
    def plain(v: Column) -> Column:
        return F.when(v.startswith('"'), F.replace(F.substring(v, F.lit(2), F.length(v) - 2), F.lit('""'), F.lit('"'))).otherwise(v)

    return F.transform(F.regexp_extract_all("line", F.lit(FIELD), F.lit(1)), plain)


def _section(values: Column) -> Column:
    """Table and version, the three fields that a header shares with its data rows."""
    return F.slice(values, 2, 3)


def headers(lines: DataFrame) -> DataFrame:
    """One row per file and section: its column names. A section's header is the same wherever it is repeated."""
    heads = lines.where(F.col("line").startswith("I,")).select("file", _values().alias("names"))
    return heads.groupBy("file", _section(F.col("names")).alias("section")).agg(F.max("names").alias("names"))


def parse_table(
    lines: DataFrame,
    fields: dict[str, str],
    time_column: str,
    *,
    key: str = "REGIONID",
    filters: dict[str, str] | None = None,
) -> DataFrame:
    """Data rows projected by name: ``file, key, stamp`` and one double per field.

    A column that a section's header lacks is NULL; ``filters`` keep rows equal by text. Sections
    whose header lacks the key or the time hold other tables and are passed over, and a row too short
    for a column that its header names is dropped. Files of several vintages come out as one table.
    The header side holds a few rows per file and its join strategy is left to the optimizer, which
    knows its size.
    """
    rows = lines.where(F.col("line").startswith("D,")).select("file", _values().alias("vals"))
    named = rows.withColumn("section", _section(F.col("vals"))).join(headers(lines), ["file", "section"])
    named = named.where(F.array_contains("names", key) & F.array_contains("names", time_column))
    wanted = [key, time_column, *fields, *(filters or {})]
    last = F.array_max(F.array(*[F.array_position("names", c) for c in wanted]))
    named = named.where(F.size("vals") >= last)

    def at(name: str) -> Column:
        place = F.array_position("names", name).cast("int")
        return F.when(place > 0, F.try_element_at("vals", F.when(place > 0, place)))

    for column, wanted in (filters or {}).items():
        named = named.where(at(column) == wanted)
    return named.select(
        "file",
        at(key).alias("region"),
        at(time_column).alias("stamp"),
        *[at(src).try_cast("double").alias(dst) for src, dst in fields.items()],
    )


def missing_required(lines: DataFrame, required: list[str]) -> DataFrame:
    """Files with a section that lacks a required column, with the missing names."""
    absent = F.array_except(F.array(*[F.lit(c) for c in required]), F.col("names"))
    return headers(lines).select("file", absent.alias("missing")).where(F.size("missing") > 0)


def read_table(
    spark: SparkSession,
    path: str,
    fields: dict[str, str],
    time_column: str,
    *,
    filters: dict[str, str] | None = None,
    required: tuple[str, ...] = (),
) -> DataFrame:
    """Read landed files; raises on a missing required column or when no row survives."""
    lines = read_lines(spark, path)
    bad = missing_required(lines, [time_column, "REGIONID", *required]).take(1)
    if bad:
        raise ValueError(f"{bad[0]['file']} lacks required columns {bad[0]['missing']}")
    table = parse_table(lines, fields, time_column, filters=filters)
    if table.isEmpty():
        raise ValueError(f"no data rows survive the filters in {path}")
    return table


def file_status(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Status per landed file: ``loaded`` with its rows, or ``skipped`` when none survived.

    A bad month is reported, not fatal; the union of good months is ``parsed`` itself.
    """
    counts = parsed.groupBy("file").agg(F.count("*").alias("rows"))
    rows = F.coalesce("rows", F.lit(0))
    return (
        lines.select("file")
        .distinct()
        .join(counts, "file", "left")
        .select("file", rows.alias("rows"), F.when(rows > 0, "loaded").otherwise("skipped").alias("status"))
    )


def with_curtailment(market: DataFrame) -> DataFrame:
    """Curtailment per technology: available minus cleared, not below zero, NULL kept."""
    out = market
    for tech in ("solar", "wind"):
        gap = F.col(f"{tech}_uigf_mw") - F.col(f"{tech}_cleared_mw")
        out = out.withColumn(f"{tech}_curtailed_mw", F.when(gap < 0, 0.0).otherwise(gap))
    return out


def combine(demand: DataFrame, price: DataFrame, rooftop: DataFrame) -> DataFrame:
    """Demand rows with price and rooftop output where they exist."""
    keys = ["region", "valid_time"]
    return demand.join(price, keys, "left").join(rooftop, keys, "left")
