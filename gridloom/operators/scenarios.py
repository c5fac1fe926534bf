"""Scenario ensembles from resampled blocks of past forecast errors.

A scenario lays one historical block of errors over the forecast window. Errors of all sites,
technologies and demand come from the same hours, so their dependence survives untouched. Block
starts are chosen once per window from the starts usable in every store. Everything stays long:
``(region, window_start, scenario, offset)`` is the working key, and sites are summed before the
first wide shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from gridloom.operators import runs
from gridloom.operators.joins import complete_hours
from gridloom.operators.splits import seeded, seeded_windows

WINDOW_KEYS = ["region", "window_start"]
DEFAULT_SCENARIOS = 200
COVERAGE_TARGET = 0.80
DISPERSION_GRID = [round(0.8 + 0.1 * i, 1) for i in range(19)]
RANK_BINS = 10


def _plus_hours(ts: Column, hours: Column) -> Column:
    return ts + F.make_dt_interval(hours=hours.cast("int"))


def error_store(frame: DataFrame, lead: int = 24) -> DataFrame:
    """(actual - p50) / capacity at one lead, averaged per (hour, site): the long store.

    A corpus without that lead is read at its most common one.
    """
    known = frame.where(F.col("actual_mw").isNotNull())
    chosen = known.groupBy("horizon_h").agg(F.count("*").alias("_n")).agg(
        F.max_by("horizon_h", F.struct((F.col("horizon_h") == lead).cast("int"), "_n", -F.col("horizon_h"))).alias("h")
    ).scalar()
    at_lead = known.where(F.col("horizon_h") == chosen)
    error = (F.col("actual_mw") - F.col("p50_mw")) / F.greatest("capacity_mw", F.lit(1e-6))
    return at_lead.groupBy("region", "tech", "site_id", "valid_time").agg(F.avg(error).alias("residual"))


def usable_windows(store: DataFrame, hours: int) -> DataFrame:
    """Window starts over which every site of the region has consecutive complete hours."""
    whole = complete_hours(store, ["region"], F.col("residual").isNotNull())
    return runs.window_starts(whole, ["region"], hours)


def latest_window(store: DataFrame, hours: int) -> DataFrame:
    found = usable_windows(store, hours).groupBy("region").agg(F.max("valid_time").alias("window_start"))
    return found


def sampled_windows(store: DataFrame, hours: int, n: int, seed: int) -> DataFrame:
    picks = seeded_windows(usable_windows(store, hours), ["region"], n, seed)
    return picks.select("region", F.col("valid_time").alias("window_start"))


def window_blocks(
    windows: DataFrame, store: DataFrame, hours: int, n_scenarios: int, seed: int, *, min_coverage: float = 0.8
) -> DataFrame:
    """``(region, window_start, scenario, block_start)``.

    A block starts at the window's hour of day, since errors are strongly diurnal, and never overlaps
    the window itself, so no scenario contains the outcome it is scored against. Starts are ordered once
    per region and hour of day, by hash; every window walks that one list and passes over the few starts
    that overlap it, so no window meets all starts. A list shorter than the scenarios is used again.
    """
    starts = runs.template_starts(store, hours, min_coverage=min_coverage).select("region", "block_start")
    overlapping = 2 * (-(-hours // 24)) - 1
    order = Window.partitionBy("region", "_hour").orderBy(seeded(F.date_format("block_start", "yyyy-MM-dd HH:mm:ss"), seed))
    ranked = starts.withColumn("_hour", F.hour("block_start")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n_scenarios + overlapping)
    lists = ranked.groupBy("region", "_hour").agg(F.array_sort(F.collect_list(F.struct("_r", "block_start"))).alias("_all"))
    apart = F.filter("_all", lambda b: F.abs(F.unix_seconds(b["block_start"]) - F.unix_seconds("window_start")) >= hours * 3600)
    fitting = windows.withColumn("_hour", F.hour("window_start")).join(lists, ["region", "_hour"]).withColumn("_fit", apart).where(F.size("_fit") > 0)
    wide = fitting.select(*WINDOW_KEYS, "_fit", F.explode(F.sequence(F.lit(0), F.lit(n_scenarios - 1))).alias("scenario"))
    return wide.select(*WINDOW_KEYS, "scenario", F.get("_fit", F.col("scenario") % F.size("_fit"))["block_start"].alias("block_start"))


def window_hours(windows: DataFrame, forecast: DataFrame, hours: int) -> DataFrame:
    """Forecast rows of each window with their hour ``offset``; windows expand, the forecast is not
    scanned per window."""
    calendar = windows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).withColumn(
        "valid_time", _plus_hours(F.col("window_start"), F.col("offset"))
    )
    return forecast.join(calendar, ["region", "valid_time"])


def block_errors(blocks: DataFrame, store: DataFrame, hours: int) -> DataFrame:
    """Errors of every scenario hour: ``(window keys, scenario, offset, site_id, residual)``."""
    wanted = blocks.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))).withColumn(
        "valid_time", _plus_hours(F.col("block_start"), F.col("offset"))
    )
    known = store.where(F.col("residual").isNotNull()).select("region", "valid_time", "site_id", "residual")
    return known.join(wanted, ["region", "valid_time"]).select(*WINDOW_KEYS, "scenario", "offset", "site_id", "residual")


def site_mw(dispersion: float | Column = 1.0) -> Column:
    """p50 moved by the error, clipped to [0, capacity]; an unknown error is zero."""
    d = dispersion if isinstance(dispersion, Column) else F.lit(float(dispersion))
    moved = F.col("p50_mw") + d * F.coalesce("residual", F.lit(0.0)) * F.col("capacity_mw")
    return F.least(F.greatest(moved, F.lit(0.0)), F.col("capacity_mw"))


def site_scenarios(
    hours: DataFrame, blocks: DataFrame, store: DataFrame, n_hours: int, dispersion: float = 1.0, *, packed: bool = False
) -> DataFrame:
    """The full ensemble per site, for export and per-site checks; unknown sites carry p50.

    Forecast hours and errors are dealt once by site, a site's forecast of a window with the picks of that window; no row of
    a site and scenario is joined or shuffled. ``hours`` are as ``window_hours`` makes them. With ``packed`` a site hour is
    one row, its scenarios and their ``mw`` two arrays.
    """
    kinds = dict(hours.dtypes) | dict(blocks.dtypes)
    points = hours.groupBy(*WINDOW_KEYS, "site_id").agg(
        F.collect_list(F.struct("offset", "valid_time", *[c.alias(n) for n, c in _move_terms().items()])).alias("_hours")
    )
    picks = blocks.groupBy(*WINDOW_KEYS).agg(F.collect_list(F.struct("scenario", "block_start")).alias("_picks"))
    offsets = F.explode(F.sequence(F.lit(0), F.lit(n_hours - 1))).alias("offset")
    needed = blocks.select("region", "block_start", offsets).select("region", _plus_hours(F.col("block_start"), F.col("offset")).alias("valid_time")).distinct()
    known = store.where(F.col("residual").isNotNull() & F.col("site_id").isNotNull()).join(needed, ["region", "valid_time"], "left_semi")
    known = known.select(F.col("region").alias("_region"), F.col("site_id").alias("_site"), "valid_time", F.col("residual").cast("double").alias("residual"))

    def spread(asked: pa.Table, errors: pa.Table) -> pa.Table:
        return _site_members(asked, errors, n_hours, dispersion)

    out = ", ".join(f"{c} {kinds[c]}" for c in [*WINDOW_KEYS, "site_id", "offset", "valid_time"])
    by_site = points.join(picks, WINDOW_KEYS).groupBy("region", "site_id").cogroup(known.groupBy("_region", "_site"))
    made = by_site.applyInArrow(spread, f"{out}, scenario array<{kinds['scenario']}>, mw array<double>")
    if packed:
        return made
    member = made.select(*WINDOW_KEYS, "offset", "valid_time", "site_id", F.explode(F.arrays_zip("scenario", "mw")).alias("_m"))
    return member.select(*WINDOW_KEYS, "_m.scenario", "offset", "valid_time", "site_id", "_m.mw")


def _move_terms() -> dict[str, Column]:
    """Forecast, capacity and upper end of a move, without nulls, so that arithmetic gives what ``site_mw`` does.

    A move from an unknown forecast or capacity ends at zero; without a capacity nothing is cut above.
    """
    unknown = F.col("p50_mw").isNull() | F.col("capacity_mw").isNull()
    capacity = F.col("capacity_mw").cast("double")
    return {"_p": F.when(unknown, F.lit(float("-inf"))).otherwise(F.col("p50_mw").cast("double")),
            "_c": F.coalesce(capacity, F.lit(0.0)), "_top": F.coalesce(capacity, F.lit(float("inf")))}


HOUR_MICROS = 3_600_000_000


def _site_members(asked: pa.Table, errors: pa.Table, n_hours: int, dispersion: float) -> pa.Table:
    """One site: for each of its windows and hours the scenarios and their mw; a repeated error gives a member each time."""
    if not asked.num_rows:
        point, pick = (asked.schema.field(c).type.value_type for c in ("_hours", "_picks"))
        kinds = {c: point.field(c).type for c in ("offset", "valid_time")} | {"scenario": pa.list_(pick.field("scenario").type), "mw": pa.list_(pa.float64())}
        none = asked.select([*WINDOW_KEYS, "site_id"])
        for name, kind in kinds.items():
            none = none.append_column(name, pa.array([], kind))
        return none
    t = errors["valid_time"].cast(pa.int64()).to_numpy()
    order = np.argsort(t, kind="stable")
    t, residual = t[order], np.r_[errors["residual"].to_numpy()[order], 0.0]
    parts = []
    for w in range(asked.num_rows):
        points, picks = asked["_hours"][w].values, asked["_picks"][w].values
        first = np.argsort(points.field("offset").to_numpy(), kind="stable")
        offset, p, c, top = (points.field(n).to_numpy(zero_copy_only=False)[first] for n in ("offset", "_p", "_c", "_top"))
        at = picks.field("block_start").cast(pa.int64()).to_numpy()[None, :] + offset.astype(np.int64)[:, None] * HOUR_MICROS
        lo = np.searchsorted(t, at, "left")
        found = np.where((offset >= 0) & (offset < n_hours), 1, 0)[:, None] * (np.searchsorted(t, at, "right") - lo)
        times = np.maximum(found, 1)
        cell = np.repeat(np.arange(times.size), times.ravel())
        turn = np.arange(len(cell)) - np.repeat(np.cumsum(times.ravel()) - times.ravel(), times.ravel())
        e = residual[np.where(found.ravel()[cell] > 0, lo.ravel()[cell] + turn, len(t))]
        hour, pick = cell // at.shape[1], cell % at.shape[1]
        mw = np.fmin(np.maximum(p[hour] + dispersion * e * c[hour], 0.0), top[hour])
        # Rows of one hour are one row here.
        heads = np.flatnonzero(np.r_[True, offset[1:] != offset[:-1]])
        ends = pa.array(np.r_[np.concatenate(([0], np.cumsum(times.sum(axis=1))))[heads], len(cell)].astype(np.int32))
        rows = points.take(pa.array(first[heads]))
        same = asked.slice(w, 1).select([*WINDOW_KEYS, "site_id"]).take(pa.array(np.zeros(len(heads), np.int64)))
        made = {"offset": rows.field("offset"), "valid_time": rows.field("valid_time"),
                "scenario": pa.ListArray.from_arrays(ends, picks.field("scenario").take(pa.array(pick))), "mw": pa.ListArray.from_arrays(ends, pa.array(mw))}
        for name, column in made.items():
            same = same.append_column(name, column)
        parts.append(same)
    return pa.concat_tables(parts)


def regional_scenarios(
    hours: DataFrame, blocks: DataFrame, store: DataFrame, n_hours: int, *,
    dispersion: float = 1.0, factors: list[float] | None = None,
) -> DataFrame:
    """Regional total per scenario hour, summed over sites as early as possible.

    total = sum of clipped p50 (once per hour) + sum of the moves caused by known errors. ``hours`` and ``blocks`` are as
    ``window_hours`` and ``window_blocks`` make them: an hour has one forecast whatever the window, and a block starts at its
    window's hour of day. With ``factors`` every total is
    given per dispersion factor.
    """
    at = [*WINDOW_KEYS, "offset"]
    still = F.least(F.greatest("p50_mw", F.lit(0.0)), F.col("capacity_mw"))
    base = hours.groupBy(*at).agg(F.sum(still).alias("_base"), F.max("valid_time").alias("valid_time"))
    grid = factors or [dispersion]
    moves = _moves(hours, blocks, store, n_hours, grid)
    extra = ["dispersion"] if factors else []
    every = base.join(blocks.select(*WINDOW_KEYS, "scenario", "block_start"), WINDOW_KEYS)
    if factors:
        every = every.withColumn("dispersion", F.explode(F.array(*[F.lit(f) for f in factors])))
    joined = every.join(moves, [*at, "block_start", *extra], "left")
    return joined.select(
        *WINDOW_KEYS, "scenario", "offset", "valid_time", *extra,
        (F.col("_base") + F.coalesce("_move", F.lit(0.0))).alias("renewable_mw"),
    )


#: Forecast and error rows of one group at most, by the mean size of a share of sites.
GROUP_ROWS = 400_000


def _moves(hours: DataFrame, blocks: DataFrame, store: DataFrame, n_hours: int, grid: list[float]) -> DataFrame:
    """``(window keys, offset, block_start, dispersion, _move)``: what the errors of a block move the regional total by.

    A window and its blocks start at one hour of day, so the forecast of an hour only ever meets errors of its own
    hour of day. Forecast, errors and the wanted pairs of hours are dealt by region, hour of day and share of the sites, each
    row once whatever the windows and scenarios; a group multiplies out its pairs over the sites it holds and sends one sum a pair.
    """
    pairs = blocks.select(*WINDOW_KEYS, "block_start").distinct().withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(n_hours - 1))))
    pairs = pairs.select(*WINDOW_KEYS, "offset", "block_start", _plus_hours(F.col("window_start"), F.col("offset")).alias("_w"), _plus_hours(F.col("block_start"), F.col("offset")).alias("_b"))
    known = store.where(F.col("residual").isNotNull() & F.col("site_id").isNotNull()).select("region", "valid_time", "site_id", "residual")
    # An hour of several windows is one row here: its forecast is the same in all of them.
    asked = hours.where(F.col("site_id").isNotNull()).select(*WINDOW_KEYS, "valid_time", "site_id", "p50_mw", "capacity_mw")
    one = asked.groupBy("region", "valid_time").agg(F.min("window_start").alias("window_start"))
    asked = asked.join(one, ["region", "valid_time", "window_start"])
    ready = _move_terms() | {"_still": F.least(F.greatest("p50_mw", F.lit(0.0)), F.col("capacity_mw")).cast("double")}
    nothing = F.lit(None).cast("double")

    def part(frame: DataFrame, kind: int, t: str, **columns: Column) -> DataFrame:
        given = {"site_id": F.lit(None).cast("string"), **dict.fromkeys(("_p", "_c", "_top", "_still", "residual"), nothing),
                 **dict.fromkeys(("window_start", "block_start", "_b"), F.lit(None).cast("timestamp")), "offset": F.lit(None).cast("int")} | columns
        return frame.select("region", F.hour(t).alias("_hour"), F.lit(kind).alias("_kind"), F.col(t).alias("_t"), *[c.alias(n) for n, c in given.items()])

    forecast = part(asked, 0, "valid_time", site_id=F.col("site_id").cast("string"), **ready)
    errors = part(known, 1, "valid_time", site_id=F.col("site_id").cast("string"), residual=F.col("residual").cast("double"))
    wanted = part(pairs, 2, "_w", window_start=F.col("window_start"), block_start=F.col("block_start"), _b=F.col("_b"), offset=F.col("offset"))
    rows = known.groupBy("region", F.hour("valid_time")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    shares = -(-rows // GROUP_ROWS) or 1
    dealt = forecast.unionByName(errors).withColumn("_share", F.pmod(F.xxhash64("site_id"), F.lit(shares)).cast("int"))
    dealt = dealt.unionByName(wanted.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))))

    def summed(table: pa.Table) -> pa.Table:
        return _group_moves(table, grid)

    out = "region string, window_start timestamp, offset int, block_start timestamp, dispersion double, _move double"
    sums = dealt.groupBy("region", "_hour", "_share").applyInArrow(summed, out)
    return sums.groupBy(*WINDOW_KEYS, "offset", "block_start", "dispersion").agg(F.sum("_move").alias("_move"))


def _slots(table: pa.Table, hour: dict, site: dict, columns: list[str], empty: list[float]) -> list[list[np.ndarray]]:
    """Matrices (hour, site) of the columns; rows that share hour and site go to further matrices."""
    t, s = (np.array([of[x] for x in table[c].to_pylist()], np.int64) for c, of in (("_t", hour), ("site_id", site)))
    cell = t * len(site) + s
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.r_[True, cell[1:] != cell[:-1]] if len(cell) else np.zeros(0, bool)
    turn = np.arange(len(cell)) - np.maximum.accumulate(np.where(first, np.arange(len(cell)), 0)) if len(cell) else cell
    out = []
    for k in range(int(turn.max()) + 1 if len(turn) else 0):
        mine = turn == k
        made = []
        for c, e in zip(columns, empty):
            m = np.full(len(hour) * len(site), e)
            m[cell[mine]] = table[c].to_numpy()[order[mine]]
            made.append(m.reshape(len(hour), len(site)))
        has = np.zeros(len(hour) * len(site), bool)
        has[cell[mine]] = True
        out.append([*made, has.reshape(len(hour), len(site))])
    return out


def _group_moves(table: pa.Table, grid: list[float]) -> pa.Table:
    """The moves of each wanted pair of hours, summed over the sites of one region, hour of day and share of sites."""
    kind = table["_kind"].to_numpy()
    forecast, errors, wanted = (table.filter(pa.array(kind == k)) for k in range(3))
    sites = sorted(set(forecast["site_id"].to_pylist()) & set(errors["site_id"].to_pylist()))
    site = {s: i for i, s in enumerate(sites)}
    both = pa.array(sites, pa.string())
    forecast, errors = (x.filter(pc.is_in(x["site_id"], value_set=both)) for x in (forecast, errors))
    at = [{x: i for i, x in enumerate(sorted(set(x["_t"].to_pylist())))} for x in (forecast, errors)]
    base = _slots(forecast, at[0], site, ["_p", "_c", "_top", "_still"], [0.0, 0.0, 0.0, 0.0])
    moved = _slots(errors, at[1], site, ["residual"], [0.0])
    w = np.array([at[0].get(x, -1) for x in wanted["_t"].to_pylist()], np.int64)
    b = np.array([at[1].get(x, -1) for x in wanted["_b"].to_pylist()], np.int64)
    total, met = np.zeros((len(w), len(grid))), np.zeros(len(w), bool)
    order = np.lexsort((b, w))
    order = order[(w[order] >= 0) & (b[order] >= 0)]
    # Pairs of the same two hours are worked out once.
    first = np.flatnonzero(np.r_[True, (w[order][1:] != w[order][:-1]) | (b[order][1:] != b[order][:-1])]) if len(order) else order
    ends = np.r_[first[1:], len(order)]
    for lo, hi in zip(first, ends):
        i, j, mine = w[order[lo]], b[order[lo]], order[lo:hi]
        for p, c, top, still, here in base:
            for residual, there in moved:
                on = here[i] & there[j]
                if not on.any():
                    continue
                met[mine] = True
                for k, d in enumerate(grid):
                    mw = np.fmin(np.maximum(p[i] + d * residual[j] * c[i], 0.0), top[i])
                    total[mine, k] += np.where(on, mw - still[i], 0.0).sum()
    rows = np.flatnonzero(met)
    keys = wanted.take(pa.array(np.repeat(rows, len(grid)))).select(["region", "window_start", "offset", "block_start"])
    return keys.append_column("dispersion", pa.array(np.tile(np.array(grid, float), len(rows)))).append_column("_move", pa.array(total[rows].ravel()))


def ensemble_quantiles(ensemble: DataFrame, keys: list[str], value: str = "renewable_mw") -> DataFrame:
    """Mean and p10/p50/p90 over scenarios; a group holds at most the number of scenarios.

    Where ``value`` is an array, a group is one row that holds its scenarios.
    """
    if isinstance(ensemble.schema[value].dataType, ArrayType):
        mean = F.aggregate(value, F.lit(0.0), lambda a, x: a + x) / F.size(value)
        ordered = ensemble.select(*keys, mean.alias("mean_mw"), F.sort_array(value).alias("_x"))
        return ordered.select(*keys, "mean_mw", *[_percentile_of("_x", p).alias(n) for n, p in (("p10_mw", 0.1), ("p50_mw", 0.5), ("p90_mw", 0.9))])
    q = F.percentile(value, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return ensemble.groupBy(*keys).agg(
        F.avg(value).alias("mean_mw"), q[0].alias("p10_mw"), q[1].alias("p50_mw"), q[2].alias("p90_mw")
    )


def _percentile_of(ordered: str, p: float) -> Column:
    """What ``percentile`` gives over the elements of an ordered array."""
    place = (F.size(ordered) - 1) * F.lit(p)
    low, high = F.floor(place), F.ceil(place)
    a, b = F.get(ordered, low.cast("int")), F.get(ordered, high.cast("int"))
    return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)


def naive_quantile_sum(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of per-site quantiles, kept for comparison: it assumes all sites err together."""
    return hours.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("p10_mw", "p50_mw", "p90_mw")])


def rank_histogram(ensemble: DataFrame, truth: DataFrame, keys: list[str], *, bins: int = RANK_BINS, by: list[str] | None = None) -> DataFrame:
    """Share of hours per rank bin of the truth within the ensemble, plus flatness.

    Flatness is the deviation of the shares times the bins: 0 when calibrated.
    """
    by = by or []
    below = ensemble.join(truth, keys).groupBy(*keys).agg(
        F.count_if(F.col("renewable_mw") < F.col("actual_mw")).alias("_r"), F.count("*").alias("_n")
    )
    ranked = below.withColumn("bin", F.least(F.floor(F.col("_r") * bins / (F.col("_n") + 1)), F.lit(bins - 1)).cast("int"))
    counts = ranked.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    groups = counts.select(*by).distinct() if by else None
    slots = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    dense = groups.select(*by, slots).join(counts, [*by, "bin"], "left") if by else counts
    whole = Window.partitionBy(*by)
    shared = dense.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.col("n") / F.sum("n").over(whole))
    return shared.withColumn("flatness", F.stddev_pop("share").over(whole) * bins)


def coverage_of(quantiles: DataFrame, truth: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """Share of hours whose truth lies in the p10-p90 band, and the mean band width."""
    inside = (F.col("actual_mw") >= F.col("p10_mw")) & (F.col("actual_mw") <= F.col("p90_mw"))
    return quantiles.join(truth, keys).groupBy(*by).agg(
        F.count("*").alias("hours"), F.avg(inside.cast("double")).alias("coverage"),
        F.avg(F.col("p90_mw") - F.col("p10_mw")).alias("mean_width"),
    )


def regional_truth(hours: DataFrame) -> DataFrame:
    return hours.groupBy(*WINDOW_KEYS, "offset").agg(F.sum("actual_mw").alias("actual_mw"))


def fit_dispersion(by_factor: DataFrame) -> DataFrame:
    """The factor whose coverage, averaged over regions, lies nearest 0.80; the smallest of equals.

    ``by_factor`` is ``(region, dispersion, coverage)``.
    """
    pooled = by_factor.groupBy("dispersion").agg(F.avg("coverage").alias("coverage"))
    gap = F.round(F.abs(F.col("coverage") - COVERAGE_TARGET), 9)
    return pooled.agg(
        F.min_by("dispersion", F.struct(gap, F.col("dispersion"))).alias("dispersion"),
        F.min_by("coverage", F.struct(gap, F.col("dispersion"))).alias("coverage"),
    )


def verify(hours: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Per region: coverage and width of the ensemble band and of the naive band, and their ratio."""
    at = [*WINDOW_KEYS, "offset"]
    truth = regional_truth(hours)
    ours = coverage_of(ensemble_quantiles(ensemble, at), truth, at, ["region"])
    naive = coverage_of(naive_quantile_sum(hours, at), truth, at, ["region"])
    return ours.join(
        naive.select("region", F.col("coverage").alias("naive_coverage"), F.col("mean_width").alias("naive_width")), "region"
    ).withColumn("width_ratio", F.try_divide(F.col("naive_width"), F.col("mean_width")))


def site_coverage(hours: DataFrame, per_site: DataFrame) -> DataFrame:
    """Per site: coverage of its own forecast band and of its scenario band."""
    at = [*WINDOW_KEYS, "offset", "site_id"]
    bands = ensemble_quantiles(per_site, at, "mw").select(*at, F.col("p10_mw").alias("_lo"), F.col("p90_mw").alias("_hi"))
    y = F.col("actual_mw")
    return hours.join(bands, at).groupBy("site_id").agg(
        F.avg(((y >= F.col("p10_mw")) & (y <= F.col("p90_mw"))).cast("double")).alias("coverage_before"),
        F.avg(((y >= F.col("_lo")) & (y <= F.col("_hi"))).cast("double")).alias("coverage_after"),
    )
