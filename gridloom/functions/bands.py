"""Quantile bands, probabilities and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORTAGE_LIKELY, SHORTAGE_POSSIBLE = 0.5, 0.2
SURPLUS_LIKELY, SURPLUS_POSSIBLE = 0.5, 0.2
COVERAGE_OK = (0.72, 0.90)
KNOTS = 20


def sorted_band(p10: Column, p50: Column, p90: Column) -> list[Column]:
    """Row-wise sort of three quantiles."""
    ordered = F.array_sort(F.array(p10, p50, p90))
    return [ordered[0].alias("p10"), ordered[1].alias("p50"), ordered[2].alias("p90")]


def widen(lower: Column, upper: Column, widening: Column, floor: float | None = 0.0) -> tuple[Column, Column]:
    """Move both edges outward; the lower edge respects the floor, the upper never crosses it."""
    low = lower - widening
    if floor is not None:
        low = F.greatest(low, F.lit(floor))
    return low, F.greatest(upper + widening, low)


def keep_median_inside(lower: Column, median: Column, upper: Column) -> tuple[Column, Column]:
    return F.least(lower, median), F.greatest(upper, median)


def action_label(p_surplus: Column, p_shortage: Column) -> Column:
    """What kind of hour it is; shortage takes precedence."""
    return (
        F.when(p_shortage >= SHORTAGE_LIKELY, "cover_shortage")
        .when(p_shortage >= SHORTAGE_POSSIBLE, "hold_reserve")
        .when(p_surplus >= SURPLUS_LIKELY, "absorb_surplus")
        .when(p_surplus >= SURPLUS_POSSIBLE, "prepare_to_absorb")
        .otherwise("normal")
    )


def map_probability(p: Column, knots: Column) -> Column:
    """Piecewise-linear map through 21 knots spaced 0.05 apart; NULL knots mean identity."""
    at = F.least(F.floor(p * KNOTS), F.lit(KNOTS - 1)).cast("int")
    left, right = F.element_at(knots, at + 1), F.element_at(knots, at + 2)
    return F.coalesce(left + (right - left) * (p * KNOTS - at), p)


def coverage_caveat(coverage: Column) -> Column:
    return F.when(
        (coverage < COVERAGE_OK[0]) | (coverage > COVERAGE_OK[1]), "coverage outside tolerance"
    ).otherwise("ok")


def energy_share(renewable: Column, demand: Column) -> Column:
    """Ratio of sums, undefined where total demand is not positive."""
    return F.when(demand > 0, renewable / F.when(demand > 0, demand))
