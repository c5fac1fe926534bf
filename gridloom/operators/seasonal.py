"""Recurring patterns in measured history: grids, monthly summaries, droughts, storage curves.

Residual is demand minus renewable, so a negative residual is a surplus everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.resample import keep_one
from gridloom.functions import bands, clock
from gridloom.operators import runs
from gridloom.operators.walk import saturating_totals

# Drought rule, round trip, storage sizes in days of surplus, capture targets.
DROUGHT_SHARE = 0.20
MIN_DROUGHT_DAYS = 2
ROUND_TRIP = 0.88
SIZE_FACTORS = (0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)
CAPTURE_TARGETS = (0.50, 0.80, 0.95)
DAYS_PER_YEAR = 365.25
MONTH_DAYS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)


def zone_of(region: Column, zones: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in zones.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), region), F.lit("UTC"))


def local_balance(market: DataFrame, zones: dict[str, str]) -> DataFrame:
    """Regional history on the local clock with the balance columns; a repeated hour of a region counts once."""
    names = market.columns
    market = keep_one(market, ["region", "valid_time"], [c for c in names if c not in ("region", "valid_time")]).select(*names)
    local = clock.local_time(F.col("valid_time"), zone_of(F.col("region"), zones))
    zero = F.lit(0.0)
    renewable = F.coalesce("solar_uigf_mw", zero) + F.coalesce("wind_uigf_mw", zero)
    curtailed = F.coalesce("solar_curtailed_mw", zero) + F.coalesce("wind_curtailed_mw", zero)
    return market.withColumns({"_local": local, "renewable_mw": renewable, "curtailed_mw": curtailed}).select(
        *market.columns, "renewable_mw", "curtailed_mw",
        F.hour("_local").alias("local_hour"), F.month("_local").alias("month"), F.to_date("_local").alias("date"),
        (F.col("demand_mw") - F.col("renewable_mw")).alias("residual_mw"),
        F.when(F.col("renewable_mw") > F.col("demand_mw"), F.col("renewable_mw") - F.col("demand_mw")).otherwise(0.0).alias("surplus_mw"),
    )


def month_hour_grids(block: DataFrame) -> DataFrame:
    """All month x hour statistics in one aggregation.

    The median holds one cell's values, at most one per day of record.
    """
    return block.groupBy("region", "month", "local_hour").agg(
        F.count("*").alias("n"),
        F.avg("surplus_mw").alias("mean_surplus_mw"),
        F.avg("residual_mw").alias("mean_residual_mw"),
        F.avg((F.col("surplus_mw") > 0).cast("double")).alias("surplus_share"),
        bands.energy_share(F.sum("renewable_mw"), F.sum("demand_mw")).alias("renewable_share"),
        F.median("rrp_aud_mwh").alias("median_price"),
    )


def dense_grid(grid: DataFrame) -> DataFrame:
    """Every region's full 12 x 24 grid; empty cells are NULL."""
    cells = grid.select("region").distinct().select(
        "region", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month")
    ).select("region", "month", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("local_hour"))
    return cells.join(grid, ["region", "month", "local_hour"], "left")


def grid_matrix(grid: DataFrame, value: str) -> DataFrame:
    """Months down, local hours across."""
    return grid.groupBy("region", "month").pivot("local_hour", list(range(24))).agg(F.first(value))


def surplus_positive_view(grid: DataFrame) -> DataFrame:
    """Surplus-positive, zero-based months, for charts."""
    return grid.select(
        "region", (F.col("month") - 1).alias("month"), F.col("local_hour").alias("hour"),
        (-F.coalesce("mean_residual_mw", F.lit(0.0))).alias("residual_mwh"),
        F.coalesce("surplus_share", F.lit(0.0)).alias("surplus_share"),
    )


def hours_over(points: DataFrame, column: str, threshold: float = 0.5) -> DataFrame:
    return points.where(F.col(column) >= threshold)


def record_years(block: DataFrame) -> DataFrame:
    """Length of record per region: whole days over 365.25."""
    span = F.floor((F.unix_seconds(F.max("valid_time")) - F.unix_seconds(F.min("valid_time"))) / 86400)
    return block.groupBy("region").agg((span / DAYS_PER_YEAR).alias("years"))


def monthly_summary(block: DataFrame) -> DataFrame:
    """Per region and month, per year of record; peak month has the most surplus energy."""
    months = block.groupBy("region", "month").agg(
        F.count_if(F.col("surplus_mw") > 0).alias("surplus_hours"),
        F.sum("surplus_mw").alias("surplus_mwh"),
        F.sum("curtailed_mw").alias("curtailed_mwh"),
        F.avg("demand_mw").alias("mean_demand_mw"),
        F.sum("renewable_mw").alias("renewable_mwh"),
        F.sum("demand_mw").alias("demand_mwh"),
        F.avg("rrp_aud_mwh").alias("mean_price"),
        F.count_if(F.col("rrp_aud_mwh") < 0).alias("negative_price_hours"),
    )
    yearly = months.join(record_years(block), "region")
    y = F.col("years")
    best = Window.partitionBy("region").orderBy(F.col("surplus_mwh").desc(), "month")
    return yearly.select(
        "region", "month", (F.col("surplus_hours") / y).alias("surplus_hours_per_year"),
        (F.col("surplus_mwh") / y).alias("surplus_mwh_per_year"),
        (F.col("curtailed_mwh") / y).alias("curtailed_mwh_per_year"), "mean_demand_mw",
        bands.energy_share(F.col("renewable_mwh"), F.col("demand_mwh")).alias("renewable_share"), "mean_price",
        (F.col("negative_price_hours") / y).alias("negative_price_hours_per_year"),
        (F.row_number().over(best) == 1).alias("is_peak_month"),
    )


def daily_totals(block: DataFrame) -> DataFrame:
    """Daily energies; a day without positive demand counts as fully covered."""
    days = block.groupBy("region", "date").agg(
        F.sum("renewable_mw").alias("renewable_mwh"), F.sum("demand_mw").alias("demand_mwh"),
        F.sum("residual_mw").alias("residual_mwh"),
    )
    return with_daily_share(days)


def with_daily_share(days: DataFrame) -> DataFrame:
    share = bands.energy_share(F.col("renewable_mwh"), F.col("demand_mwh"))
    return days.withColumn("share", F.coalesce(share, F.lit(1.0)))


def drought_runs(days: DataFrame, *, threshold: float = DROUGHT_SHARE, min_days: int = MIN_DROUGHT_DAYS) -> DataFrame:
    """Runs of days whose renewable share stays under the threshold."""
    found = runs.runs_where(
        days, ["region"], "date", F.col("share") < threshold,
        [F.sum("renewable_mwh").alias("_r"), F.sum("demand_mwh").alias("_d"), F.sum(F.col("demand_mwh") - F.col("renewable_mwh")).alias("residual_mwh")],
        min_length=min_days,
    )
    return found.select(
        "region", "starts", "ends", F.col("length"), F.month("starts").alias("month"),
        (F.col("_r") / F.greatest(F.col("_d"), F.lit(1e-9))).alias("mean_share"), "residual_mwh",
    )


def drought_summary(days: DataFrame, droughts: DataFrame) -> DataFrame:
    """Count, yearly rates, duration quantiles and longest run; zero rows for quiet regions."""
    years = days.groupBy("region").agg((F.datediff(F.max("date"), F.min("date")) / DAYS_PER_YEAR).alias("years"))
    stats = droughts.groupBy("region").agg(
        F.count("*").alias("n"), F.sum("length").alias("total_days"),
        F.percentile("length", F.lit(0.5)).alias("p50"), F.percentile("length", F.lit(0.9)).alias("p90"),
        F.max("length").alias("longest"), F.max_by("starts", F.struct("length", -F.unix_date("starts"))).alias("longest_from"),
    )
    n, y = F.coalesce("n", F.lit(0)), F.col("years")
    return years.join(stats, "region", "left").select(
        "region", n.alias("count"), (n / y).alias("per_year"), (F.coalesce("total_days", F.lit(0)) / y).alias("days_per_year"),
        "p50", "p90", "longest", "longest_from",
    )


def droughts_by_month(droughts: DataFrame) -> DataFrame:
    return droughts.groupBy("region", "month").agg(F.count("*").alias("n"))


def storage_adequacy(block: DataFrame, *, power_mw: float | None = None, blocked_by: str = "month") -> DataFrame:
    """Captured share of surplus for ten storage sizes per region.

    Charging is limited by power and room, discharging by power and content, with the square root
    of the round-trip efficiency each way. Regions without a surplus give no rows.
    """
    eta = ROUND_TRIP**0.5
    surplus = F.col("surplus_mw")
    positive = F.when(surplus > 0, surplus)
    power = F.lit(power_mw) if power_mw is not None else F.percentile(positive, F.lit(0.99))
    totals = (
        block.groupBy("region")
        .agg(F.sum(surplus).alias("total"), power.cast("double").alias("power_mw"))
        .where(F.col("total") > 0)
        .join(record_years(block), "region")
        .withColumn("years", F.greatest("years", F.lit(1e-9)))
    )
    daily = F.greatest(F.col("total") / F.col("years") / DAYS_PER_YEAR, F.lit(1.0))
    sizes = F.array(*[F.round(daily * f, 1) for f in SIZE_FACTORS])
    steps = block.join(totals.select("region", "power_mw"), "region").select(
        "region", "valid_time", F.date_trunc(blocked_by, "valid_time").alias("_block"),
        F.when(surplus > 0, F.least(surplus, F.col("power_mw")) * eta)
        .otherwise(-F.least(F.greatest(F.col("residual_mw"), F.lit(0.0)), F.col("power_mw")) / eta).alias("delta"),
    )
    stored = saturating_totals(steps, ["region"], "_block", "valid_time", "delta", totals.select("region", F.explode(sizes).alias("capacity")))
    return stored.join(totals, "region").select(
        "region", F.col("capacity").alias("energy_mwh"), "power_mw",
        (F.col("capacity") / F.col("power_mw")).alias("duration_h"),
        (F.col("rise") / eta / F.col("total")).alias("captured_share"),
        (F.col("rise") / eta / F.col("years")).alias("captured_mwh_per_year"),
    )


def capture_targets(curve: DataFrame) -> DataFrame:
    """The smallest size reaching each capture target, if any does."""
    target = F.explode(F.array(*[F.lit(x) for x in CAPTURE_TARGETS])).alias("target")
    hit = F.when(F.col("captured_share") >= F.col("target"), F.col("energy_mwh"))
    return curve.select("*", target).groupBy("region", "target").agg(
        F.min(hit).alias("energy_mwh"), F.min_by("captured_share", hit).alias("captured_share")
    )


def typical_day_storage(view: DataFrame) -> DataFrame:
    """Storage that shifts a typical day's surplus into its deficit, in the month needing most.

    ``view`` is the surplus-positive grid. Recurring hours are weighted by days of the month.
    """
    x = F.col("residual_mwh")
    days = F.element_at(F.array(*[F.lit(d) for d in MONTH_DAYS]), F.col("month") + 1)
    months = view.groupBy("region", "month").agg(
        F.sum(F.when(x > 0, x).otherwise(0.0)).alias("surplus"), F.sum(F.when(x < 0, -x).otherwise(0.0)).alias("deficit"),
        F.count_if(x > 0).alias("hours"),
    )
    need = F.when(F.col("deficit") > 0, F.least("surplus", "deficit")).otherwise(F.col("surplus"))
    return months.groupBy("region").agg(
        F.max(need).alias("storage_mwh"), F.sum(F.col("hours") * days).alias("recurring_hours"),
        F.sum(F.col("surplus") * days).alias("recurring_mwh"),
    )
