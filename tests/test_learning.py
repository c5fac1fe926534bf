"""Learned bands on the site with the most structure in the driver's data, and the stream."""

import pytest
from pyspark.sql import functions as F

from gridloom.plans import training
from gridloom.plans.registry import load_catalogue, run
from gridloom.streaming import hourly

BIG = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["band_training", "band_scoring", "demand_scoring", "model_benchmark", "balance_verification"])
def test_fitting_queries_run(spark, name):
    q = load_catalogue()[name]
    frame = run(q, spark, BIG)
    assert frame.columns == [c for c, _ in q.columns] and frame.count() > 0


def test_bands_are_ordered_and_bounded(spark):
    scored = run(load_catalogue()["band_scoring"], spark, BIG)
    assert scored.where("p10_mw > p50_mw OR p50_mw > p90_mw OR p10_mw < 0").count() == 0


def test_model_round_trip_and_coverage(spark, tmp_path):
    n = 6000
    h = F.element_at(F.array(F.lit(24), F.lit(48), F.lit(72)), (F.col("id") % 3 + 1).cast("int"))
    frame = spark.range(n).select(
        (F.rand(1) * 0.8).alias("x"), h.alias("horizon_h"), F.rand(2).alias("u"), F.col("id"),
        F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("calib"), F.lit("test")), (F.floor(F.col("id") / 3) % 4 + 1).cast("int")).alias("split"),
    ).withColumn("target", F.col("x") + (F.col("u") - 0.5) * 0.2).withColumn("denominator_mw", F.lit(10.0))
    from gridloom.session import materialise

    frame = materialise(frame)
    model = training.train_bands(frame, ["x", "horizon_h"], rounds=10, depth=3)
    test = training.score_bands(frame.where("split = 'test'"), model)
    inside = test.select(F.avg(((F.col("target") * 10 >= F.col("p10_mw")) & (F.col("target") * 10 <= F.col("p90_mw"))).cast("double"))).first()[0]
    assert 0.74 <= inside <= 0.88
    model.save(str(tmp_path / "m"))
    again = training.score_bands(frame.where("split = 'test'"), training.BandModel.load(spark, str(tmp_path / "m"), model.feature_order))
    assert again.select("id", "p50_mw", "p90_mw").exceptAll(test.select("id", "p50_mw", "p90_mw")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.range(4000).select(
        (F.col("id") % 3500).alias("event_id"), F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 3500) * 60 + F.col("id") % 7 * 100).alias("ts"),
        F.concat(F.lit("k"), (F.col("id") % 3500 % 2).cast("string")).alias("event_type"), ((F.col("id") % 3500) % 11 - 2).cast("double").alias("value"))
    # Repeats lie in the same file as their first copy; times jitter within the lateness.
    rows.where("event_id < 2000").coalesce(1).write.parquet(str(tmp_path / "in"))
    rows.where("event_id >= 2000").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = hourly.hourly_stream(hourly.read_events(spark, str(tmp_path / "in"), "*.parquet"), ["event_type"], "ts", "value", id_column="event_id")
    hourly.run_available(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    unique = rows.dropDuplicates(["event_id"])
    top = unique.agg(F.max("ts")).first()[0]
    batch = unique.groupBy("event_type", F.date_trunc("hour", "ts").alias("valid_time")).agg(F.avg(F.greatest("value", F.lit(0.0))).alias("m")).where(
        F.col("valid_time") + F.expr("interval 3 hours") <= F.lit(top))
    joined = batch.join(got, ["event_type", "valid_time"])
    assert got.count() == batch.count() == joined.count() > 50
    assert joined.where(F.abs(F.col("m") - F.col("mean_value")) > 1e-9).count() == 0


def test_demand_is_scored_at_every_horizon(spark):
    from gridloom.operators.features import HORIZONS

    scored = run(load_catalogue()["demand_scoring"], spark, BIG)
    assert {r.horizon_h for r in scored.select("horizon_h").distinct().collect()} == set(HORIZONS)
