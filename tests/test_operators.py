"""Closed forms, brute force on small fixtures, and the synthetic cases of the blueprint."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom.functions import bands, clock, solar, wind
from gridloom.operators import balance, calibration, contracts, features, fitting, metrics, planning, runs, scenarios, seasonal, splits
from gridloom.operators.quantiles import exact_quantiles
from gridloom.operators.resample import dense_hours, keep_one
from gridloom.operators.walk import saturating_totals

HOUR0 = 1704067200


def hours(spark, n, *columns):
    return spark.range(n).select(F.timestamp_seconds(F.lit(HOUR0) + F.col("id") * 3600).alias("valid_time"), "id", *columns)


def test_easter_and_holidays(spark):
    known = {2000: "04-23", 2008: "03-23", 2011: "04-24", 2019: "04-21", 2024: "03-31", 2025: "04-20", 2026: "04-05", 1981: "04-19", 1954: "04-18"}
    years = spark.createDataFrame([(y,) for y in known], "y int").select("y", F.date_format(clock.easter_sunday(F.col("y")), "MM-dd").alias("e"))
    assert {r.y: r.e for r in years.collect()} == known


def test_power_curve_and_day_length(spark):
    v = spark.createDataFrame([(x,) for x in (2.0, 3.0, 12.0, 20.0, 25.5)], "v double")
    got = [r[0] for r in v.select(wind.power_curve(F.col("v"), F.lit(3.0), F.lit(12.0), F.lit(25.0))).collect()]
    assert got == [0.0, 0.0, 1.0, 1.0, 0.0]
    grid = spark.createDataFrame([(lat, d) for lat in (0.0, 45.0, -45.0, 80.0) for d in (80, 172, 355)], "lat double, d int")
    day = {(r.lat, r.d): r.h for r in grid.select("lat", "d", solar.day_length_hours(F.col("lat"), F.col("d")).alias("h")).collect()}
    assert day[(0.0, 172)] == pytest.approx(12.0) and day[(45.0, 172)] > 15 and day[(80.0, 172)] == 24.0 and day[(80.0, 355)] == 0.0
    assert day[(45.0, 172)] == pytest.approx(24 - day[(-45.0, 172)])


@pytest.mark.parametrize("longitude", [150.0, 0.0, -75.0, 72.5])
def test_longitude_round_trip(spark, longitude):
    solar_hour = (F.hour("valid_time") + longitude / 15.0 + 48) % 24
    bell = F.greatest(F.lit(0.0), F.cos((solar_hour - 12) * math.pi / 12))
    power = hours(spark, 24 * 120, F.lit("S").alias("site_id")).withColumn("power_mw", bell)
    assert abs(fitting.longitude_from_output(power).first().longitude - longitude) < 8


def test_latitude_from_day_length(spark):
    lat, lon = -34.0, 0.0
    year = solar.with_sun(hours(spark, 24 * 366, F.lit("S").alias("site_id"), F.lit(lat).alias("latitude"), F.lit(lon).alias("longitude")), {"now": F.col("valid_time")})
    power = year.select("site_id", "valid_time", F.greatest(F.col("sun_now"), F.lit(0.0)).alias("power_mw"))
    assert abs(fitting.latitude_from_output(power).first().latitude - lat) < 8


@pytest.mark.parametrize("shape", ["smooth", "hot", "ties", "tiny"])
def test_exact_quantiles_equal_numpy(spark, shape):
    rng = np.random.default_rng(5)
    values = {"smooth": rng.normal(size=5000), "hot": np.r_[rng.normal(size=200), np.full(4000, 1.25)], "ties": rng.integers(0, 4, 3000).astype(float), "tiny": np.array([3.0])}[shape]
    frame = spark.createDataFrame(pd.DataFrame({"k": "a", "v": values}))
    for accuracy in (10_000, 20):  # a poor sketch must not change the result
        got = {r.level: r.quantile for r in exact_quantiles(frame, ["k"], "v", [0.1, 0.5, 0.995], accuracy=accuracy).collect()}
        for q, x in got.items():
            assert x == pytest.approx(np.quantile(values, q), abs=1e-12)
    # Brackets of a few values: many rounds, a sketch that knows next to nothing, one group with every row.
    for bracket, accuracy in ((3, 10_000), (2, 1)):
        got = {r.level: r.quantile for r in exact_quantiles(frame, ["k"], "v", [0.1, 0.5, 0.995], accuracy=accuracy, bracket=bracket).collect()}
        for level, value in got.items():
            assert value == pytest.approx(np.quantile(values, level))
    high = exact_quantiles(frame, ["k"], "v", [0.8], method="higher").first().quantile
    assert high == np.quantile(values, 0.8, method="higher")


def test_conformal_reaches_coverage(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"y": rng.normal(size=6000), "h": rng.choice([6, 30, 60], 6000)})
    frame = spark.createDataFrame(pdf).select("y", F.col("h").alias("horizon_h"), calibration.conformity(F.col("y"), F.lit(-0.2), F.lit(0.2)).alias("score"))
    table = {r.lead_bucket: r.widening for r in calibration.widening_by_bucket(frame, []).collect()}
    assert set(table) == {"1-24h", "25-48h", "49-72h", "all"}
    q = table["all"]
    assert 0.80 <= np.mean((pdf.y >= -0.2 - q) & (pdf.y <= 0.2 + q)) < 0.81


def brute_walk(deltas, capacity):
    x = up = down = 0.0
    for d in deltas:
        y = min(max(x + d, 0.0), capacity)
        up, down, x = up + max(y - x, 0), down + max(x - y, 0), y
    return up, down


def test_blocked_walk_equals_sequential(spark):
    rng = np.random.default_rng(3)
    deltas = rng.normal(scale=5, size=700)
    steps = spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(700), "b": [i // 37 for i in range(700)], "d": deltas}))
    sizes = spark.createDataFrame([("a", 3.0), ("a", 12.0), ("a", 500.0)], "k string, capacity double")
    for r in saturating_totals(steps, ["k"], "b", "i", "d", sizes).collect():
        up, down = brute_walk(deltas, r.capacity)
        assert (r.rise, r.fall) == (pytest.approx(up), pytest.approx(down))


def flat_block(spark, surplus, deficit):
    rows = [(HOUR0 + i * 3600, s, d) for i, (s, d) in enumerate(zip(surplus, deficit))]
    return spark.createDataFrame(rows, "s long, surplus_mw double, d double").select(
        F.lit("R").alias("region"), F.timestamp_seconds("s").alias("valid_time"), "surplus_mw", (F.col("d") - F.col("surplus_mw")).alias("residual_mw"))


def captured(spark, block, energy, power):
    eta = seasonal.ROUND_TRIP**0.5
    delta = F.when(F.col("surplus_mw") > 0, F.least("surplus_mw", F.lit(power)) * eta).otherwise(-F.least(F.col("residual_mw"), F.lit(power)) / eta)
    steps = block.select("region", "valid_time", F.to_date("valid_time").alias("b"), delta.alias("d"))
    sizes = spark.createDataFrame([("R", energy)], "region string, capacity double")
    return saturating_totals(steps, ["region"], "b", "valid_time", "d", sizes).first().rise / eta


def test_storage_limits(spark):
    assert captured(spark, flat_block(spark, [1000.0] * 48, [0.0] * 48), 100.0, 50.0) <= 100 / 0.88**0.5 + 1e-9
    assert captured(spark, flat_block(spark, [100.0, 0.0] * 24, [0.0, 100.0] * 24), 100.0, 100.0) > 100


def test_storage_curve_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    s, d = rng.normal(size=24 * 90) * 40, rng.normal(size=24 * 90)
    surplus = np.maximum(s, 0)
    block = flat_block(spark, [float(x) for x in surplus], [float(x) for x in np.maximum(-s, 0)])
    eta, years = 0.88**0.5, (len(s) - 1) // 24 / 365.25
    power = np.quantile(surplus[surplus > 0], 0.99)
    deltas = [min(x, power) * eta if x > 0 else -min(-x, power) / eta for x in s]
    del d
    for r in seasonal.storage_adequacy(block).collect():
        assert r.power_mw == pytest.approx(power)
        assert r.captured_share == pytest.approx(brute_walk(deltas, r.energy_mwh)[0] / eta / surplus.sum())
        assert r.captured_mwh_per_year == pytest.approx(r.captured_share * surplus.sum() / years)


def test_event_runs(spark):
    p, e = [0, 0.9, 0, 0.9, 0.9, 0.9, 0, 0], [0, 10, 0, 20, 20, 20, 0, 0]
    points = spark.createDataFrame([("R", HOUR0 + i * 3600, float(a), float(b)) for i, (a, b) in enumerate(zip(p, e))], "region string, s long, p_surplus double, expected_surplus_mw double")
    found = runs.event_runs(points.withColumn("valid_time", F.timestamp_seconds("s")), "surplus").collect()
    assert [(r.hours, r.energy_mwh, r.peak_probability) for r in found] == [(3, 60.0, 0.9)]


def store(spark, n_hours, sites, skip=()):
    base = hours(spark, n_hours).where(~F.col("id").isin(*skip)) if skip else hours(spark, n_hours)
    noise = (F.abs(F.xxhash64("id", "site_id")) % 1000) / 1000.0 - 0.5
    return base.withColumn("site_id", F.explode(F.array(*[F.lit(s) for s in sites]))).select(
        F.lit("R").alias("region"), "valid_time", "site_id", noise.alias("residual"), F.lit(50.0).alias("p50_mw"), F.lit(100.0).alias("capacity_mw"), F.lit(50.0).alias("actual_mw"))


def test_blocks_do_not_cross_gaps(spark):
    starts = runs.template_starts(store(spark, 200, "ABCDE", skip=range(50, 60)), 24)
    got = [int(r.s) for r in starts.select(((F.unix_seconds("block_start") - HOUR0) / 3600).alias("s")).collect()]
    assert len(got) == 27 + 117 and not [s for s in got if s + 23 >= 50 and s < 60]


def test_unknown_site_keeps_p50_and_totals_agree(spark):
    known = store(spark, 600, "ABCDE")
    window = spark.createDataFrame([("R", HOUR0 + 240 * 3600)], "region string, s long").select("region", F.timestamp_seconds("s").alias("window_start"))
    blocks = scenarios.window_blocks(window, known, 24, 60, 3)
    assert blocks.count() == 60
    assert blocks.where((F.hour("block_start") != F.hour("window_start")) | (F.abs(F.unix_seconds("block_start") - F.unix_seconds("window_start")) < 86400)).count() == 0
    forecast = known.unionByName(known.where("site_id = 'A'").withColumn("site_id", F.lit("NEW")))
    at = scenarios.window_hours(window, forecast, 24)
    per_site = scenarios.site_scenarios(at, blocks, known, 24, 1.4)
    assert per_site.where("site_id = 'NEW' AND mw <> 50").count() == 0
    assert per_site.where("mw < 0 OR mw > 100").count() == 0
    total = scenarios.regional_scenarios(at, blocks, known, 24, dispersion=1.4)
    both = per_site.groupBy("scenario", "offset").agg(F.sum("mw").alias("x")).join(total, ["scenario", "offset"])
    assert both.count() == 60 * 24 and both.where(F.abs(F.col("x") - F.col("renewable_mw")) > 1e-6).count() == 0
    wide = scenarios.regional_scenarios(at, blocks, known, 24, factors=[0.8, 2.0])
    spread = {r.dispersion: r.s for r in wide.groupBy("dispersion").agg(F.stddev_pop("renewable_mw").alias("s")).collect()}
    assert spread[2.0] > spread[0.8]


@pytest.mark.parametrize("demand,headroom,expected", [(100.0, 500.0, (1.0, 0.0)), (1000.0, 100.0, (0.0, 1.0)), (400.0, 500.0, (0.0, 0.0))])
def test_balance_probabilities(spark, demand, headroom, expected):
    window = F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("window_start")
    base = spark.range(50 * 12).select(F.lit("R").alias("region"), window, (F.col("id") % 12).cast("int").alias("offset"), F.floor(F.col("id") / 12).cast("int").alias("scenario"))
    gen = base.select("*", F.lit(300.0).alias("renewable_mw"), F.col("window_start").alias("valid_time"))
    members = balance.scenario_balance(base.withColumn("demand_mw", F.lit(demand)), gen, spark.createDataFrame([("R", headroom)], "region string, headroom_mw double"))
    points = balance.balance_points(members).collect()
    assert len(points) == 12
    for p in points:
        assert (p.p_surplus, p.p_shortage) == expected
        assert p.expected_surplus_mw == pytest.approx(p.p_surplus * p.conditional_surplus_mw)
        assert p.residual_p10_mw <= p.residual_p50_mw <= p.residual_p90_mw


def test_demand_blocks_cycle_over_valid_ones(spark):
    ts = lambda h: F.timestamp_seconds(F.lit(HOUR0 + h * 3600))
    demand = hours(spark, 48, F.lit("R").alias("region"), F.lit(0.1).alias("residual"))
    blocks = spark.createDataFrame([(0, 0), (1, 500), (2, 10), (3, 600)], "scenario int, h int").select(
        F.lit("R").alias("region"), ts(24).alias("window_start"), "scenario", F.timestamp_seconds(F.lit(HOUR0) + F.col("h") * 3600).alias("block_start"))
    got = {r.scenario: r.h for r in balance.demand_blocks(blocks, demand, 24).select("scenario", ((F.unix_seconds("block_start") - HOUR0) / 3600).alias("h")).collect()}
    assert got == {0: 0, 1: 10, 2: 10, 3: 10}
    none = balance.demand_blocks(blocks.where("scenario IN (1, 3)"), demand, 24).collect()
    assert [r.block_start for r in none] == [None, None]


def test_isotonic_map(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(size=2000)
    pdf = pd.DataFrame({"region": "R", "p": p, "o": (rng.uniform(size=2000) < np.minimum(2 * p, 1)).astype(float)})
    knots = calibration.fit_probability_maps(spark.createDataFrame(pdf), ["region"], "p", "o").first().knots
    assert knots[0] == 0 and knots[-1] == 1 and all(a <= b for a, b in zip(knots, knots[1:])) and knots[6] > 0.35
    assert calibration.fit_probability_maps(spark.createDataFrame(pdf.head(10)), ["region"], "p", "o").first().knots is None
    assert spark.range(1).select(bands.map_probability(F.lit(0.3), F.lit(None).cast("array<double>")).alias("x")).first().x == 0.3


def test_energy_share_is_a_ratio_of_sums(spark):
    frame = spark.createDataFrame([("a", d, 400.0) for d in (1000.0, 500.0, -100.0, 800.0)] + [("b", -5.0, 1.0)], "k string, demand_mw double, renewable_mw double")
    assert {r.k: r.share for r in fitting.energy_share(frame, ["k"]).collect()} == {"a": pytest.approx(1600 / 2200), "b": None}


def test_folds_and_holdout(spark):
    frame = hours(spark, 5000)
    folds = splits.forward_folds(frame, 3)
    stats = {(r.fold, r.role): (r.lo, r.hi) for r in folds.groupBy("fold", "role").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert all(stats[(f, "train")][1] < stats[(f, "valid")][0] for f in (1, 2, 3)) and stats[(3, "valid")][1] == 4999
    held = splits.holdout_split(hours(spark, 1000), 0.2).where("is_holdout").agg(F.min("id"), F.count("*")).first()
    assert held[0] == 1000 - held[1] and 195 <= held[1] <= 205


def test_rank_matches_a_global_sort(spark):
    frame = spark.range(3000).select(F.col("id").cast("string").alias("site_id"))
    got = {r.site_id: r["rank"] for r in splits.distributed_rank(frame, F.md5("site_id")).collect()}
    import hashlib

    order = sorted(got, key=lambda s: hashlib.md5(s.encode()).hexdigest())
    assert [got[s] for s in order] == list(range(1, 3001))


def test_lags_do_not_cross_leads(spark):
    frame = hours(spark, 50, F.lit("S").alias("site_id")).withColumn("horizon_h", F.explode(F.array(F.lit(24), F.lit(48)))).withColumn("x", F.col("id") + F.col("horizon_h") * 1000.0)
    rows = frame.select("id", "x", *features.neighbours("x", features.per_lead())).where("id BETWEEN 3 AND 46")
    assert rows.where((F.col("x_lead1") != F.col("x") + 1) | (F.col("x_lag3") != F.col("x") - 3) | (F.col("x_delta") != 1)).count() == 0


def test_issue_relative_lags(spark):
    market = hours(spark, 600, F.lit("R").alias("region"), F.col("id").cast("double").alias("demand_mw"), F.lit(1.0).alias("rooftop_pv_mw"))
    rows = features.at_issue_time(features.expand_horizons(market, (48,)), features.load_history(market)).where("id = 500").first()
    assert (rows.load_lag_1h, rows.load_lag_24h, rows.load_lag_168h) == (451.0, 428.0, 284.0)


def test_contract_errors(spark):
    rows = hours(spark, 50, F.lit("S").alias("site_id"), F.lit("api").alias("source")).select(
        "site_id", F.col("valid_time").alias("issue_time_utc"), (F.col("valid_time") + F.expr("interval 24 hours")).alias("valid_time_utc"), F.when(F.col("id") == 7, 99).otherwise(24).alias("horizon_h"), "source")
    with pytest.raises(contracts.ContractError, match="horizon_mismatch x1"):
        contracts.enforce(rows, contracts.WEATHER, contracts.weather_rules())
    good = rows.withColumn("horizon_h", F.lit(24))
    table = contracts.enforce(good, contracts.WEATHER, contracts.weather_rules())
    assert table.columns == list(contracts.WEATHER.columns) and table.schema["ghi_wm2"].dataType.typeName() == "float"
    with pytest.raises(contracts.ContractError, match="duplicate key"):
        contracts.enforce(good.union(good), contracts.WEATHER)
    with pytest.raises(contracts.ContractError, match="missing required"):
        contracts.conform(good.drop("source"), contracts.WEATHER)
    with pytest.raises(contracts.ContractError, match="cloud_total"):
        contracts.require_columns(table, ["cloud_total"], "solar")
    with pytest.raises(contracts.ContractError, match="differ"):
        contracts.align_features(good, ["nope"])


def test_dense_grid_and_dedup_under_a_hot_key(spark):
    hot = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"),
                                    F.timestamp_seconds(F.lit(HOUR0) + (F.col("id") % 97) * 7200).alias("t"), F.col("id").alias("v"))
    one = keep_one(hot, ["k", "t"], ["v"], keep="last")
    expected = hot.groupBy("k", "t").agg(F.max("v").alias("m"))
    assert one.join(expected, ["k", "t"]).where("v <> m").count() == 0 and one.count() == expected.count()
    dense = dense_hours(one, ["k"], "t", ["v"])
    assert dense.where("k = 'hot'").count() == 193 and dense.where("v IS NOT NULL").count() == one.count()


def test_calendars_are_written_where_their_rows_lie(spark):
    rows = [(k, t, v) for k in ("a", None) for t, v in ((0, 1.0), (5400, 2.0), (5400, 3.0), (14400, None), (None, 7.0))] + [("one", 60, 4.0), ("none", None, 5.0)]
    frame = spark.createDataFrame(rows, "k string, s long, v double").withColumn("t", F.timestamp_seconds("s"))
    dense = dense_hours(frame, ["k"], "t", ["v"])
    wanted = [(k, t, v) for k in ("a", None) for t, v in ((0, 1.0), (3600, None), (5400, 3.0), (7200, None), (10800, None), (14400, None), (None, 7.0))] + [("one", 60, 4.0), ("none", None, 5.0)]
    got = [(r.k, r.s, r.v) for r in dense.select("k", F.unix_seconds("t").alias("s"), "v").collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    # Nothing is hashed or shuffled after the calendar is written: one task cannot hold the hours of all keys.
    plan = dense._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.index("Generate") < plan.index("Aggregate")


def test_site_balance_conserves_energy(spark):
    rng = np.random.default_rng(4)
    points = spark.createDataFrame([("S", HOUR0 + i * 3600, float(g), 10.0, 6.0, 20.0, 5.0) for i, g in enumerate(rng.uniform(0, 25, 72).round(2))],
                                   "site_id string, s long, gen_mw double, demand_mw double, power_mw double, energy_mwh double, start_mwh double").withColumn("valid_time", F.timestamp_seconds("s"))
    hours_ = planning.site_balance(points, ["site_id"])
    total = planning.balance_totals(hours_, ["site_id"]).first()
    assert total.surplus_hours + total.shortage_hours == 72
    last = hours_.orderBy(F.col("i").desc()).first()
    assert last.level == pytest.approx(5.0 + total.charge_energy - hours_.agg(F.sum("discharged")).first()[0])
    staged, checks = planning.schedule_checks(hours_.withColumns({"power_mw": F.lit(6.0), "energy_mwh": F.lit(20.0)}), ["site_id"])
    assert all(r.passed for r in contracts.audit([(n, staged, c) for n, c in checks]).collect())


def test_skill_and_brier_edges(spark):
    frame = spark.createDataFrame([Row(k="never", p=0.1, o=0.0), Row(k="never", p=0.2, o=0.0), Row(k="some", p=1.0, o=1.0), Row(k="some", p=0.0, o=0.0)])
    got = {r.k: r.skill for r in metrics.brier(frame, ["k"], "p", "o").collect()}
    assert got == {"never": None, "some": 1.0}


def test_schedule_audit_reports_each_violation(spark):
    good = {"i": 0, "stored": 2.0, "discharged": 0.0, "level_before": 0.0, "level": 2.0, "power_mw": 6.0, "energy_mwh": 25.0}
    rows = [
        {"k": "fine"}, {"k": "fine", "i": 1, "stored": 0.0, "discharged": 1.0, "level_before": 2.0, "level": 1.0},
        {"k": "power", "stored": 7.0, "level": 7.0}, {"k": "energy", "level_before": 24.0, "level": 26.0},
        {"k": "both", "discharged": 1.0, "level": 1.0}, {"k": "jump", "level": 5.0}, {"k": "unknown", "level": None},
    ]
    hours = spark.createDataFrame(pd.DataFrame([good | r for r in rows]).astype({"level": "Float64"}))
    hours = hours.withColumn("level", F.when(~F.isnan("level"), F.col("level")))
    staged, checks = planning.schedule_checks(hours, ["k"])
    found = {r.check: r.failures for r in contracts.audit([(n, staged, c) for n, c in checks]).collect()}
    assert found == {"power_limit": 1, "energy_bounds": 2, "no_simultaneous": 1, "level_continuity": 2}


def test_differing_rows_find_a_moved_value(spark):
    left = spark.createDataFrame([(1, 2.0), (2, None), (2, None)], "h int, v double")
    assert contracts.differing_rows(left, left).count() == 0
    right = spark.createDataFrame([(1, 2.5), (2, None)], "h int, v double")
    assert contracts.differing_rows(left, right).groupBy("h").count().orderBy("h").collect() == [(1, 2), (2, 1)]


def test_runs_end_with_their_window_and_at_a_hole(spark):
    rows = [("a", w, h, 0.9) for w, hours in (("w1", (0, 1, 2, 5, 6)), ("w2", (3, 4))) for h in hours]
    points = spark.createDataFrame(rows, "region string, window_start string, h int, p_surplus double").select(
        "region", "window_start", F.timestamp_seconds(F.col("h") * 3600).alias("valid_time"), "p_surplus", F.lit(10.0).alias("expected_surplus_mw")
    )
    found = runs.event_runs(points, "surplus").orderBy("window_start", "from_utc").collect()
    assert [(r.window_start, r.hours, r.energy_mwh) for r in found] == [("w1", 3, 30.0), ("w1", 2, 20.0), ("w2", 2, 20.0)]


def test_error_store_falls_back_to_the_common_lead(spark):
    rows = [("r", "solar", "s", h, lead, 5.0, 4.0, 0.0 if h == 3 else 10.0) for h in range(4) for lead in (48, 72) if lead == 48 or h]
    frame = spark.createDataFrame(rows, "region string, tech string, site_id string, h int, horizon_h int, actual_mw double, p50_mw double, capacity_mw double")
    store = scenarios.error_store(frame.withColumn("valid_time", F.timestamp_seconds(F.col("h") * 3600))).orderBy("valid_time").collect()
    assert [round(r.residual, 6) for r in store] == [0.1, 0.1, 0.1, 1_000_000.0]


def test_panel_uses_given_beam_and_diffuse(spark):
    rows = [(500.0, 700.0, 100.0), (500.0, None, 100.0), (500.0, None, None)]
    frame = spark.createDataFrame(rows, "ghi double, dni double, dhi double")
    one = F.lit(0.5)
    got = [r[0] for r in frame.select(solar.plane_of_array(F.col("ghi"), F.lit(0.4), one, F.lit(0.8), F.lit(30.0), (F.col("dni"), F.col("dhi")))).collect()]
    own = frame.select(solar.plane_of_array(F.col("ghi"), F.lit(0.4), one, F.lit(0.8), F.lit(30.0))).first()[0]
    ground = 500 * (1 - np.cos(np.radians(30))) * (solar.GROUND_ALBEDO / 2)
    assert got[0] == pytest.approx(700 * 0.8 + 100 * (np.cos(np.radians(30)) + 1) / 2 + ground)
    assert got[1] == got[2] == own


def test_sun_bearing(spark):
    noon = F.lit(0.0)
    rows = spark.createDataFrame([(51.0,), (-34.0,)], "latitude double")
    south, north = [r[0] for r in rows.select(solar.azimuth_deg(F.lit(0.0), noon, F.col("latitude"))).collect()]
    assert south == pytest.approx(180) and min(north, 360 - north) == pytest.approx(0, abs=1e-6)
    morning, evening = spark.range(1).select(*[solar.azimuth_deg(F.lit(0.0), F.lit(h), F.lit(0.1)) for h in (-1.2, 1.2)]).first()
    assert 80 < morning < 100 and 260 < evening < 280
