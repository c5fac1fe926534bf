"""Table contracts and audits. Every check is an aggregation that yields rows, never a row loop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.clock import hours_between

# Plausibility bounds of the contracts.
IRRADIANCE_BOUNDS = (-1.0, 1400.0)
WIND_BOUNDS = (0.0, 90.0)
POWER_TOLERANCE = -0.01
DEMAND_BOUNDS = (-1000.0, 20000.0)
PRICE_BOUNDS = (-1000.0, 20000.0)
NEGATIVE_DEMAND_SHARE = 0.01
TECHNOLOGIES = ("solar", "wind")
MIN_COMMON_ROWS = 100
MIN_CORRELATION = 0.85


@dataclass(frozen=True)
class Contract:
    """Declared columns with Spark types, the key, and the columns that may be absent."""

    name: str
    columns: dict[str, str]
    key: tuple[str, ...]
    optional: frozenset[str] = field(default_factory=frozenset)


_WEATHER_VALUES = (
    "ghi_wm2", "dni_wm2", "dhi_wm2", "cloud_total", "cloud_low", "cloud_mid", "cloud_high",
    "temp_2m_c", "rh_pct", "pressure_hpa", "precip_mm", "wind_speed_10m", "wind_speed_100m",
    "wind_dir_10m_deg", "wind_dir_100m_deg",
)

WEATHER = Contract(
    "weather",
    {
        "site_id": "string", "issue_time_utc": "timestamp", "valid_time_utc": "timestamp",
        "horizon_h": "smallint", **{c: "float" for c in _WEATHER_VALUES}, "source": "string",
    },
    ("site_id", "issue_time_utc", "valid_time_utc"),
    frozenset(_WEATHER_VALUES),
)
POWER = Contract(
    "power",
    {
        "site_id": "string", "valid_time_utc": "timestamp", "tech": "string",
        "power_mw": "float", "capacity_mw": "float", "is_valid": "boolean",
    },
    ("site_id", "valid_time_utc"),
)
MARKET = Contract(
    "market",
    {
        "valid_time_utc": "timestamp", "region": "string", "demand_mw": "double",
        "available_generation_mw": "double", "aemo_demand_forecast_mw": "double",
        "net_interchange_mw": "double", "solar_uigf_mw": "double", "wind_uigf_mw": "double",
        "solar_cleared_mw": "double", "wind_cleared_mw": "double", "battery_energy_mwh": "double",
        "rrp_aud_mwh": "double", "rooftop_pv_mw": "double", "solar_curtailed_mw": "double",
        "wind_curtailed_mw": "double",
    },
    ("region", "valid_time_utc"),
    frozenset({"aemo_demand_forecast_mw", "battery_energy_mwh", "rooftop_pv_mw"}),
)


class ContractError(ValueError):
    """A table breaks its contract."""


def conform(frame: DataFrame, contract: Contract) -> DataFrame:
    """Coerce types and order columns; absent optional columns become typed NULL, NaN becomes NULL."""
    missing = [c for c in contract.columns if c not in frame.columns and c not in contract.optional]
    if missing:
        raise ContractError(f"{contract.name}: missing required columns {missing}")

    def one(name: str, kind: str) -> Column:
        if name not in frame.columns:
            return F.lit(None).cast(kind).alias(name)
        c = F.col(name).try_cast(kind)
        if kind in ("float", "double"):
            c = F.when(~F.isnan(c), c)
        return c.alias(name)

    return frame.select(*[one(n, k) for n, k in contract.columns.items()])


def duplicate_keys(frame: DataFrame, key: tuple[str, ...] | list[str]) -> DataFrame:
    return frame.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def rule_counts(frame: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass over the table: ``(rule, violations)``. NULL comparisons do not violate."""
    counts = frame.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")


def weather_rules(
    issue: str = "issue_time_utc", valid: str = "valid_time_utc", columns: list[str] | None = None
) -> dict[str, Column]:
    columns = columns or list(WEATHER.columns)
    rules = {
        "negative_horizon": F.col("horizon_h") < 0,
        "horizon_mismatch": F.col("horizon_h") != hours_between(F.col(valid), F.col(issue)),
    }
    for c in ("ghi_wm2", "dni_wm2", "dhi_wm2"):
        if c in columns:
            rules[f"{c}_range"] = ~F.col(c).between(*IRRADIANCE_BOUNDS)
    for c in ("wind_speed_10m", "wind_speed_100m"):
        if c in columns:
            rules[f"{c}_range"] = ~F.col(c).between(*WIND_BOUNDS)
    return rules


def power_rules() -> dict[str, Column]:
    return {
        "unknown_tech": ~F.col("tech").isin(*TECHNOLOGIES),
        "nonpositive_capacity": F.col("capacity_mw") <= 0,
        "negative_power": F.col("is_valid") & (F.col("power_mw") < F.col("capacity_mw") * POWER_TOLERANCE),
    }


def site_rules() -> dict[str, Column]:
    return {
        "blank_id": F.trim("site_id") == "",
        "latitude_range": ~F.col("latitude").between(-90, 90),
        "longitude_range": ~F.col("longitude").between(-180, 180),
        "nonpositive_capacity": F.col("capacity_mw") <= 0,
        "speed_order": ~((F.col("cut_in_ws_ms") < F.col("rated_ws_ms")) & (F.col("rated_ws_ms") < F.col("cut_out_ws_ms"))),
    }


def request_is_identifiable() -> Column:
    """A request names a site, or gives latitude, longitude, technology and capacity."""
    whole = F.lit(True)
    for c in ("latitude", "longitude", "tech", "capacity_mw"):
        whole = whole & F.col(c).isNotNull()
    return F.col("site_id").isNotNull() | whole


def enforce(frame: DataFrame, contract: Contract, rules: dict[str, Column] | None = None) -> DataFrame:
    """Conform, then raise on a duplicate key or a broken rule. Runs two aggregations."""
    table = conform(frame, contract)
    twice = duplicate_keys(table, contract.key).take(1)
    if twice:
        raise ContractError(f"{contract.name}: duplicate key {twice[0].asDict()}")
    if rules:
        broken = rule_counts(table, rules).where(F.col("violations") > 0).collect()
        if broken:
            found = ", ".join(f"{r['rule']} x{r['violations']}" for r in broken)
            raise ContractError(f"{contract.name}: {found}")
    return table


def column_presence(frame: DataFrame, needed: list[str]) -> DataFrame:
    """``(column, present, filled)``: exists in the schema, and non-null row count."""
    here = [c for c in needed if c in frame.columns]
    counts = frame.agg(
        *[F.count(c).alias(c) for c in here],
        *[F.lit(0).cast("long").alias(c) for c in needed if c not in here],
    )
    return counts.unpivot([], needed, "column", "filled").withColumn("present", F.col("column").isin(*here))


def require_columns(frame: DataFrame, needed: list[str], context: str) -> DataFrame:
    absent = column_presence(frame, needed).where(F.col("filled") == 0).collect()
    if absent:
        raise ContractError(f"{context}: columns absent or all missing: {[r['column'] for r in absent]}")
    return frame


def market_audit(market: DataFrame) -> DataFrame:
    """Market checks ``(check, value, passed)`` in one aggregation over per-key counts.

    Duplicates are found by counting keys first, which combines map-side.
    """
    per_key = market.groupBy("region", "valid_time").agg(
        F.count("*").alias("n"),
        F.min("demand_mw").alias("d_lo"), F.max("demand_mw").alias("d_hi"),
        F.min("rrp_aud_mwh").alias("p_lo"), F.max("rrp_aud_mwh").alias("p_hi"),
        F.count_if(F.col("demand_mw") < 0).alias("neg"), F.count("demand_mw").alias("with_demand"),
    )
    totals = per_key.agg(
        F.count_if(F.col("n") > 1).cast("double").alias("duplicate_keys"),
        F.min("d_lo").alias("demand_min"), F.max("d_hi").alias("demand_max"),
        F.min("p_lo").alias("price_min"), F.max("p_hi").alias("price_max"),
        (F.sum("neg") / F.sum("with_demand")).alias("negative_demand_share"),
    )
    long = totals.unpivot(
        [], ["duplicate_keys", "demand_min", "demand_max", "price_min", "price_max", "negative_demand_share"],
        "check", "value",
    )
    passed = (
        F.when(F.col("check") == "duplicate_keys", F.col("value") == 0)
        .when(F.col("check").startswith("demand"), F.col("value").between(*DEMAND_BOUNDS))
        .when(F.col("check").startswith("price"), F.col("value").between(*PRICE_BOUNDS))
        .otherwise(F.col("value") <= NEGATIVE_DEMAND_SHARE)
    )
    return long.withColumn("passed", passed)


def band_order_violations(points: DataFrame) -> DataFrame:
    """Points whose quantiles are out of order."""
    return points.where(~((F.col("p10_mw") <= F.col("p50_mw")) & (F.col("p50_mw") <= F.col("p90_mw"))))


def horizon_integrity(points: DataFrame, keys: list[str]) -> DataFrame:
    """Per forecast: point count, distinct horizons, and whether they are unique and positive.

    Counted through ``(forecast, horizon)`` groups so repeats collapse before the shuffle.
    """
    per_h = points.groupBy(*keys, "horizon_h").agg(F.count("*").alias("n"))
    return per_h.groupBy(*keys).agg(
        F.sum("n").alias("points"),
        F.count("*").alias("horizons"),
        ((F.sum("n") == F.count("*")) & (F.min("horizon_h") >= 1)).alias("valid"),
    )


def align_features(features: DataFrame, expected: list[str]) -> DataFrame:
    """Stored feature order; raises when the builder lacks one."""
    missing = [c for c in expected if c not in features.columns]
    if missing:
        raise ContractError(f"feature builder produced no {missing}: train and serve differ")
    return features.select(*expected)


def compare_sources(left: DataFrame, right: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Per variable on common rows: n, correlation, both means, mean absolute difference.

    Variables with fewer than 100 common rows are left out; ``agrees`` asks for correlation over
    0.85 on each.
    """
    joined = left.select(*keys, *[F.col(v).alias(f"a_{v}") for v in variables]).join(
        right.select(*keys, *[F.col(v).alias(f"b_{v}") for v in variables]), keys
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"a_{v}").alias("a"), F.col(f"b_{v}").alias("b")) for v in variables])
    )
    long = joined.select(pairs.alias("p")).select("p.*").where(F.col("a").isNotNull() & F.col("b").isNotNull())
    stats = long.groupBy("variable").agg(
        F.count("*").alias("n"),
        F.corr("a", "b").alias("correlation"),
        F.avg("a").alias("mean_left"),
        F.avg("b").alias("mean_right"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"),
    )
    return stats.where(F.col("n") >= MIN_COMMON_ROWS).withColumn(
        "agrees", F.coalesce(F.col("correlation") > MIN_CORRELATION, F.lit(False))
    )


def corpus_coverage(wanted: DataFrame, corpus: DataFrame) -> DataFrame:
    """Per wanted site: covered or missing, and the leads present."""
    leads = corpus.groupBy("site_id").agg(F.array_sort(F.collect_set("horizon_h")).alias("leads"))
    return wanted.select("site_id").join(leads, "site_id", "left").select(
        "site_id", F.col("leads").isNotNull().alias("covered"), F.concat_ws(",", "leads").alias("leads")
    )


def differing_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in one table and not in the other, with multiplicity: ``side`` plus all columns."""
    return (
        left.exceptAll(right).withColumn("side", F.lit("left"))
        .unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    )


def audit(checks: list[tuple[str, DataFrame, Column]]) -> DataFrame:
    """Union of one-row aggregations ``(check, failures, passed)``.

    Each entry is a name, a table and a row predicate that must never be false. Predicates over the
    same table are folded into one scan.
    """
    by_table: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, frame, predicate in checks:
        by_table.setdefault(id(frame), (frame, {}))[1][name] = ~F.coalesce(predicate, F.lit(False))
    out = None
    for frame, rules in by_table.values():
        part = rule_counts(frame, rules)
        out = part if out is None else out.unionByName(part)
    return out.select(
        F.col("rule").alias("check"), F.col("violations").alias("failures"),
        (F.col("violations") == 0).alias("passed"),
    )
