"""Registry of named queries: a Spark plan, its output contract and its SQL oracle.

The output contract is one string such as ``"site_id:s valid_time:t power_mw:f n:i"``. Both sides
are projected through it, so names, types and rounding agree by construction:
``s`` string, ``i`` long, ``f`` double rounded to 6 places, ``t`` second-precision stamp as text,
``d`` date as text, ``b`` boolean as 0/1.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.adapters import CTES, Tables

# Added before rounding on both sides: means of two-decimal readings often end exactly on half a
# unit of the sixth place, where the last bit of a sum would decide the digit.
NUDGE = 0.000000013


@dataclass(frozen=True)
class Query:
    name: str
    ids: tuple[str, ...]
    columns: tuple[tuple[str, str], ...]
    plan: Callable[[Tables], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, columns: str, sql: str | None = None):
    """Register a plan over ``Tables`` under ``name``; ``ids`` are the inventory rows it covers."""
    spec = tuple((c.split(":")[0], (c.split(":") + ["s"])[1]) for c in columns.split())

    def register(plan: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, tuple(ids.split()), spec, plan, sql)
        return plan

    return register


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "t":
        c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    elif kind == "d":
        c = F.date_format(c, "yyyy-MM-dd")
    elif kind == "f":
        c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
    elif kind == "i":
        c = c.cast("long")
    elif kind == "b":
        c = c.cast("int").cast("long")
    else:
        c = c.cast("string")
    return c.alias(name)


def _sql_column(name: str, kind: str) -> str:
    quoted = f'"{name}"'
    forms = {
        "t": f"strftime({quoted}, '%Y-%m-%d %H:%M:%S')",
        "d": f"strftime({quoted}, '%Y-%m-%d')",
        "f": f"round(CAST({quoted} AS DOUBLE) + CAST({NUDGE:.9f} AS DOUBLE), 6) + CAST(0 AS DOUBLE)",
        "i": f"CAST({quoted} AS BIGINT)",
        "b": f"CAST(CAST({quoted} AS INTEGER) AS BIGINT)",
        "s": f"CAST({quoted} AS VARCHAR)",
    }
    return f"{forms[kind]} AS {quoted}"


def run(q: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = q.plan(Tables(spark, sf_dir))
    return frame.select(*[_spark_column(n, k) for n, k in q.columns])


def _with_clause(body: str) -> str:
    """The CTEs a body needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                visit(CTES[name].replace(name, ""))
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    parts = ", ".join(f"{n} AS ({CTES[n].strip()})" for n in ordered)
    return f"WITH {parts} " if parts else ""


def oracle(q: Query) -> str | None:
    if q.sql is None:
        return None
    projected = ", ".join(_sql_column(n, k) for n, k in q.columns)
    return f"{_with_clause(q.sql)}SELECT {projected} FROM ({q.sql.strip()}) AS q"


def load_catalogue() -> dict[str, Query]:
    from gridloom.plans import (  # noqa: F401
        catalog_aggregates,
        catalog_contracts,
        catalog_joins,
        catalog_learning,
        catalog_planning,
        catalog_projections,
        catalog_scenarios,
        catalog_sources,
        catalog_windows,
    )

    return REGISTRY
