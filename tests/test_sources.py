"""Readers and sinks over files on disk."""

import json

import pytest
from pyspark.sql import functions as F

from gridloom.sources import hourly_json, market, meter, payloads, stations, tables, tracks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_meter_file(spark, tmp_path):
    path = write(tmp_path / "m.csv", "\n".join([
        "C,HEADER,2024", "I,DISPATCH,UNIT,1,STAMP,DUID,MW",
        'D,DISPATCH,UNIT,1,"2024/01/01 00:05:00",A1,5.5', "D,DISPATCH,UNIT,1,2024/01/01 00:10:00,A1,bad",
        "D,DISPATCH,UNIT,1,2024/01/01 00:10:00,B2,7", "D,SHORT,1",
    ]))
    lines = meter.read_lines(spark, path)
    rows = meter.parse_readings(lines)
    assert sorted((r.unit, r.stamp, r.mw) for r in rows.collect()) == [("A1", "2024/01/01 00:05:00", 5.5), ("B2", "2024/01/01 00:10:00", 7.0)]
    only = spark.createDataFrame([("B2",)], "unit string")
    assert [r.unit for r in meter.parse_readings(lines, only).collect()] == ["B2"]
    assert {r.unit for r in meter.distinct_units(rows).collect()} == {"A1", "B2"}


def test_market_vintages_union_and_errors(spark, tmp_path):
    write(tmp_path / "in" / "old.csv", "I,D,S,1,REGIONID,SETTLEMENTDATE,INTERVENTION,TOTALDEMAND\nD,D,S,1,SA1,2024/01/01 00:05:00,0,100\nD,D,S,1,SA1,2024/01/01 00:10:00,1,999")
    write(tmp_path / "in" / "new.csv", 'I,D,S,2,SETTLEMENTDATE,REGIONID,TOTALDEMAND,INTERVENTION,SS_WIND_UIGF\nD,D,S,2,"2024/02/01 00:05:00","VIC1",50,0,12.5')
    fields = {"TOTALDEMAND": "demand_mw", "SS_WIND_UIGF": "wind_uigf_mw"}
    got = market.read_table(spark, str(tmp_path / "in"), fields, "SETTLEMENTDATE", filters={"INTERVENTION": "0"}, required=("TOTALDEMAND",))
    assert sorted((r.region, r.demand_mw, r.wind_uigf_mw) for r in got.collect()) == [("SA1", 100.0, None), ("VIC1", 50.0, 12.5)]
    with pytest.raises(ValueError, match="required"):
        market.read_table(spark, str(tmp_path / "in"), fields, "SETTLEMENTDATE", required=("SS_WIND_UIGF",))
    with pytest.raises(ValueError, match="no data rows"):
        market.read_table(spark, str(tmp_path / "in"), fields, "SETTLEMENTDATE", filters={"INTERVENTION": "7"})
    lines = meter.read_lines(spark, str(tmp_path / "in"))
    status = market.file_status(lines, got)
    assert {r.file.rsplit("/", 1)[1]: r.status for r in status.collect()} == {"old.csv": "loaded", "new.csv": "loaded"}


def test_station_geojson(spark, tmp_path):
    unit = lambda tech, cap, status: {"fuel_tech": tech, "capacity_registered": cap, "status": status}
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [138.5, -33.1]},
         "properties": {"station_code": "AAA", "name": "A", "state": "SA", "duid_data": [unit("wind", 10, "operating"), unit("wind", 5, "retired")]}},
        {"type": "Feature", "geometry": {"type": "MultiPoint", "coordinates": [[150.0, -30.0], [1, 2]]},
         "properties": {"station_code": "AAAB", "name": "B", "state": "NSW", "duid_data": [unit("solar_utility", 7, "operating"), unit("wind", 1, "operating")]}},
    ]}
    found = stations.read_stations(spark, write(tmp_path / "s.geojson", json.dumps(doc, indent=1)))
    rows = {r.station: r for r in found.collect()}
    assert (rows["AAA"].longitude, rows["AAA"].latitude, rows["AAA"].capacity_mw) == (138.5, -33.1, 15.0)
    assert (rows["AAAB"].longitude, rows["AAAB"].latitude) == (150.0, -30.0)
    units = spark.createDataFrame([("AAA",), ("AAAB1",), ("AAAX",), ("ZZZ",)], "unit string")
    got = {r.unit: (r.station, r.tech) for r in stations.resolve_units(units, found).collect()}
    assert got == {"AAA": ("AAA", "wind"), "AAAB1": ("AAAB", "solar"), "AAAX": ("AAA", "wind")}


def test_track_deaccumulates_only_rising_columns(spark, tmp_path):
    head = "ZONEID,TIMESTAMP,VAR169,VAR175"
    rows = [f"1,20240101 {h}:00,{100 * h},{(-1) ** h}" for h in range(1, 24)]
    path = write(tmp_path / "t.csv", "\n".join([head, *rows]))
    raw = tracks.with_run(tracks.read_tracks(spark, path)).withColumns({c: F.col(c).cast("double") for c in ("VAR169", "VAR175")})
    flat = tracks.deaccumulate(raw, ["VAR169", "VAR175"], ["ZONEID", "issue_time_utc"], "valid_time_utc").orderBy("valid_time_utc").collect()
    assert [r.VAR169 for r in flat] == [100.0] * 23
    assert [r.VAR175 for r in flat][:3] == [-1.0, 1.0, -1.0]
    assert [r.horizon_h for r in flat] == list(range(1, 24))


def test_hourly_json_absent_variable_is_null(spark):
    block = json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None], "cloud_cover": [50, 100]}})
    frame = spark.createDataFrame([("S", block)], "site_id string, payload string").withColumn("issue_time", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    rows = hourly_json.hourly_rows(frame).orderBy("valid_time").collect()
    assert [(r.temp_2m_c, r.cloud_total, r.ghi_wm2, r.horizon_h) for r in rows] == [(1.5, 0.5, None, 0), (None, 1.0, None, 1)]


def test_canonical_sink_prunes_and_splits(spark, tmp_path):
    frame = spark.range(2000).select(
        F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("site_id"), F.when(F.col("id") % 2 == 0, "solar").otherwise("wind").alias("tech"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).alias("valid_time"), F.col("id").cast("double").alias("power_mw"))
    path = str(tmp_path / "power")
    tables.write_canonical(frame, path)
    back = tables.read_canonical(spark, path, tech="solar", site_id="S1")
    assert back.count() == frame.where("tech = 'solar' AND site_id = 'S1'").count()
    plan = back._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(tech" in plan and "EqualTo(site_id,S1)" in plan


def test_upsert_and_duplicates(spark):
    old = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "site_id string, cap double, name string")
    new = spark.createDataFrame([("b", None, "z"), ("c", 3.0, None)], "site_id string, cap double, name string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, "site_id").collect()) == [("a", 1.0, "x"), ("b", 2.0, "z"), ("c", 3.0, None)]
    with pytest.raises(ValueError, match="duplicate"):
        tables.load_sites(old.union(old))


def test_calibration_documents_round_trip(spark, tmp_path):
    maps = spark.createDataFrame([("SA1", "surplus", [0.0, 1.0], [0.0, 1.0], 5), ("SA1", "shortage", [0.0, 1.0], [0.1, 0.9], 6)], "region string, event string, x array<double>, y array<double>, n int")
    payloads.save_calibration(maps, str(tmp_path / "cal"))
    docs = spark.read.text(str(tmp_path / "cal")).withColumnRenamed("value", "document")
    assert sorted(tuple(r) for r in payloads.calibration_maps(docs).collect()) == sorted(tuple(r) for r in maps.collect())


def test_ensemble_and_nested_sinks(spark, tmp_path):
    members = spark.range(60).select(F.lit("R1").alias("region"), (F.col("id") % 6).cast("int").alias("scenario"),
                                     F.timestamp_seconds(F.col("id") * 3600).alias("valid_time"), F.col("id").cast("double").alias("mw"))
    tables.write_ensemble(members, str(tmp_path / "e"))
    assert tables.first_scenarios(spark.read.parquet(str(tmp_path / "e")), 2).count() == 20
    nested = payloads.nest(members.where("scenario = 0"), ["region"], "valid_time", ["mw"])
    payloads.write_json(nested, str(tmp_path / "j"))
    assert len(spark.read.json(str(tmp_path / "j")).first().points) == 10
    payloads.write_flat(members, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 60


def test_table_catalogue_lookup(spark):
    spark.range(1).createOrReplaceTempView("multi_weather")
    spark.range(1).createOrReplaceTempView("multi_power")
    spark.range(1).createOrReplaceTempView("single_weather")
    halves = tables.table_halves(spark, ["single", "multi", "none"])
    assert [r.corpus for r in tables.preferred_corpora(halves, ["single", "multi"]).collect()] == ["multi"]
