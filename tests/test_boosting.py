"""Quantile boosting, block picks, month loads and the tracking mount on planted cases and against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import solar
from gridloom.operators import boosting, features, fitting, scenarios, splits
from gridloom.operators.quantiles import exact_quantiles
from gridloom.plans import training
from gridloom.session import discard, materialise
from gridloom.sources import tables

NAMES = ["x", "spread"]


def planted(spark, n=4000, folds=0):
    """The spread of the target follows a feature; a median with one width for all cannot show it."""
    rows = spark.range(n).select(
        "id", (F.rand(1) * 0.8).alias("x"), (F.rand(5) * 0.9 + 0.1).alias("spread"), F.rand(2).alias("u"), (F.col("id") % max(folds, 1)).cast("int").alias("fold"),
        F.when(F.col("id") % 4 == 3, boosting.VALID).otherwise(boosting.TRAIN).alias("role"),
    ).withColumn("target", F.col("x") + (F.col("u") - 0.5) * F.col("spread"))
    roles = [F.when(F.col("fold") == g, boosting.IDLE).otherwise(F.col("role")) for g in range(folds)] or [F.col("role")]
    return materialise(rows.withColumn("roles", F.array(*roles)))


def test_outer_quantiles_follow_a_feature(spark):
    data = planted(spark)
    trees = boosting.fit(data, NAMES, [0.1, 0.5, 0.9], rounds=8, depth=3, step=0.4)
    rows = boosting.predicted(data.where("role = 2"), trees).select("target", "spread", "q").toPandas()
    q = np.array(rows.q.tolist())
    y = rows.target.to_numpy()
    assert 0.74 <= np.mean((y >= q[:, 0]) & (y <= q[:, 2])) <= 0.86
    width = q[:, 2] - q[:, 0]
    assert width[rows.spread > 0.8].mean() > 2 * width[rows.spread < 0.3].mean()
    # Against a median with residual quantiles by its own value, as one width for all spreads.
    loss = lambda f, a: np.mean(np.where(y > f, a * (y - f), (a - 1) * (y - f)))
    for k, a in ((0, 0.1), (2, 0.9)):
        assert loss(q[:, k], a) < loss(q[:, 1] + np.quantile(y - q[:, 1], a), a)


def test_staged_losses_equal_a_loop_over_prefixes(spark):
    data = planted(spark, 1500)
    trees = boosting.fit(data, NAMES, [0.5, 0.9], rounds=5, depth=2, step=0.5)
    rows = data.select(F.col("target").alias("y"), "roles", boosting.binned(data, NAMES, trees.edges).alias("bins"))
    staged = {(r.m, r.round): r.loss for r in boosting.staged_loss(rows, trees).collect()}
    kept = trees.kept
    for k in range(6):
        trees.kept = [k, k]
        scored = boosting.predicted(data.where("role = 2"), trees)
        for m, a in enumerate(trees.alphas):
            mean = scored.agg(F.avg(boosting.pinball(F.lit(a), F.col("target"), F.get("q", F.lit(m))))).first()[0]
            assert abs(mean - staged[m, k]) < 1e-12
    assert kept == [min(range(6), key=lambda k: (round(staged[m, k], 9), k)) for m in range(2)]


def test_folds_together_equal_folds_one_by_one(spark):
    data = planted(spark, 1500, folds=3)
    both = boosting.fit(data, NAMES, [0.1, 0.5], groups=3, rounds=3, depth=3, step=0.4)
    for g in range(3):
        alone = data.withColumn("roles", F.array(F.get("roles", F.lit(g))))
        # Edges are shared by all folds together; one fold is given the same.
        one = boosting.fit(alone, NAMES, [0.1, 0.5], rounds=3, depth=3, step=0.4)
        if one.edges == both.edges:
            assert [t[2 * g : 2 * g + 2] for t in both.splits] == one.splits and [t[2 * g : 2 * g + 2] for t in both.leaves] == one.leaves
        inside = boosting.predicted(data.where(F.col("fold") == g), both, "a", F.lit(g)).select("id", "a")
        assert inside.count() == 500 and inside.where("a IS NULL OR a[0] IS NULL").count() == 0


def test_tree_table_scores_as_the_model_does(spark):
    data = planted(spark, 1200)
    trees = boosting.fit(data, NAMES, [0.5], rounds=3, depth=3, step=0.5)
    trees.kept = [3]
    table = {(r.tree, r.node): r for r in trees.table(spark).collect()}
    for r in boosting.predicted(data, trees).limit(200).collect():
        f = trees.base[0]
        for tree in range(3):
            node = 1
            while table[tree, node].feature is not None:
                t = table[tree, node]
                node = t.left if round(r[t.feature], 6) <= t.threshold else t.right
            f += 0.5 * table[tree, node].value
        assert r.q[0] == pytest.approx(f, abs=1e-12)
    again = boosting.Ensemble.from_json(trees.to_json())
    assert again == trees


def test_no_rows_and_constant_features_give_the_start_value(spark):
    data = planted(spark, 300).withColumn("x", F.lit(1.0)).withColumn("spread", F.lit(2.0))
    trees = boosting.fit(data, NAMES, [0.5], rounds=2, depth=2)
    assert trees.splits == [[{}], [{}]]
    empty = boosting.fit(data.limit(0), NAMES, [0.5], rounds=2, depth=2)
    assert empty.base == [0.0] and empty.kept == [2]


def test_share_quantiles_and_both_paths_agree(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.rand(3) * 50).cast("int").cast("double").alias("v"))
    for method in ("linear", "higher", "share"):
        fast = sorted(map(tuple, exact_quantiles(rows, ["k"], "v", [0.1, 0.5, 0.995], method=method).collect()))
        slow = sorted(map(tuple, exact_quantiles(rows, ["k"], "v", [0.1, 0.5, 0.995], method=method, bracket=5, accuracy=20).collect()))
        assert fast == slow


def test_picks_walk_one_list(spark):
    hours = spark.range(24 * 90).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("valid_time"))
    store = hours.crossJoin(spark.createDataFrame([("a", "r"), ("b", "r")], "site_id string, region string")).withColumn("residual", F.lit(0.1))
    windows = hours.where("hour(valid_time) IN (0, 6)").limit(60).select(F.lit("r").alias("region"), F.col("valid_time").alias("window_start"))
    for n in (7, 200):
        got = scenarios.window_blocks(windows, store, 72, n, 5)
        from gridloom.operators import runs

        starts = runs.template_starts(store, 72).select("region", "block_start")
        apart = F.abs(F.unix_seconds("block_start") - F.unix_seconds("window_start")) >= 72 * 3600
        pairs = windows.join(starts, "region").where((F.hour("block_start") == F.hour("window_start")) & apart)
        wanted = splits.scenario_picks(pairs, scenarios.WINDOW_KEYS, n, 5)
        columns = ["region", "window_start", "scenario", "block_start"]
        assert got.count() == wanted.count() > 0
        assert got.select(*columns).exceptAll(wanted.select(*columns)).count() == 0


def test_months_are_replaced_and_nothing_else(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "site_id string, tech string, valid_time timestamp, power_mw double"
    from datetime import datetime

    first = [(f"s{i}", "solar", datetime(2024, m, d, h), 1.0) for i in range(3) for m in (1, 2) for d in (1, 2) for h in range(3)]
    tables.load_months(spark.createDataFrame(first, schema), path)
    late = [("s1", "solar", datetime(2024, 2, 1, 0), 9.0), ("s9", "wind", datetime(2024, 2, 1, 0), 2.0), ("s1", "solar", datetime(2024, 3, 1, 0), 4.0)]
    for _ in range(2):
        tables.load_months(spark.createDataFrame(late, schema), path)
    rows = {(r.site_id, r.tech, r.valid_time): r.power_mw for r in spark.read.parquet(path).collect()}
    wanted = {(a, b, c): d for a, b, c, d in first + late}
    assert rows == wanted and spark.read.parquet(path).count() == len(wanted)
    tables.load_months(spark.createDataFrame([], schema), path)
    assert spark.read.parquet(path).count() == len(wanted)


def test_a_tracking_plant_is_found(spark):
    sites = spark.createDataFrame(
        [("fix", 50.0, -30.0, 145.0, None, None), ("turn", 50.0, -30.0, 145.0, None, None)],
        "site_id string, capacity_mw double, latitude double, longitude double, tilt_deg double, azimuth_deg double",
    )
    hours = spark.range(24 * 366).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("valid_time"))
    rows = hours.crossJoin(sites).withColumn("temp_2m_c", F.lit(25.0)).withColumn("tracking", F.col("site_id") == "turn")
    power = features.clear_sky_power(features.with_panel(rows, dc_ac_ratio=1.4)).select("site_id", "valid_time", F.col("clearsky_ac_mw").alias("power_mw"))
    found = {r.site_id: (r.mount, r.dc_ac_ratio) for r in fitting.fit_plant(materialise(power), sites).collect()}
    assert found == {"fix": ("fixed", 1.4), "turn": ("single_axis", 1.4)}


def test_trackers_face_the_sun_and_turn_back(spark):
    rows = spark.createDataFrame([(h,) for h in (-85.0, -40.0, 0.0, 40.0, 85.0)], "h double")
    turn = solar.tracker_rotation(F.lit(0.0), F.radians("h"), F.lit(0.0))
    got = [np.degrees(r[0]) for r in rows.select(turn).collect()]
    assert got[1:4] == pytest.approx([-40, 0, 40]) and got[0] == pytest.approx(-got[4])
    # At 85 degrees a row's shadow would reach the next one: cos(85) / 0.35 = cos(75.6).
    assert got[4] == pytest.approx(85 - np.degrees(np.arccos(np.cos(np.radians(85)) / solar.GROUND_COVER)))


def test_discarded_tables_are_gone(spark):
    table = materialise(spark.range(3))
    path = table._written
    discard(table)
    from pathlib import Path

    assert not Path(path.removeprefix("file:")).exists()
    discard(spark.range(3))


def test_leave_sites_out_scores_every_site(spark):
    n = 3000
    rows = spark.range(n).select(
        F.concat(F.lit("s"), (F.col("id") % 6).cast("string")).alias("site_id"), F.timestamp_seconds(F.lit(1704067200) + (F.col("id") / 6).cast("long") * 3600).alias("valid_time"),
        F.lit(24).alias("horizon_h"), (F.rand(1) * 0.8).alias("x"), F.rand(2).alias("u"), F.lit("train").alias("split"), F.lit(10.0).alias("denominator_mw"),
    ).withColumn("target", F.col("x") + (F.col("u") - 0.5) * 0.2).withColumn("power_mw", F.col("target") * 10)
    scored = training.leave_sites_out(materialise(rows), ["x"], 3, rounds=4, depth=3, step=0.5)
    assert scored.count() == n and scored.where("p10_mw > p50_mw OR p50_mw > p90_mw").count() == 0
    error = scored.agg(F.avg(F.abs(F.col("p50_mw") - F.col("power_mw")))).first()[0]
    assert error < 0.9
