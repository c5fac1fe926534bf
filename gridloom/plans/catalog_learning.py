"""Catalogue: splits, folds, learned bands and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import boosting, contracts, features, metrics, splits
from gridloom.operators.resample import keep_one
from gridloom.plans import learning_sql as sql
from gridloom.plans import training
from gridloom.plans.adapters import REGION_CLOCKS, folder_state
from gridloom.plans.registry import query
from gridloom.session import materialise

_MODELS: dict = {}


def _once(t, name, make):
    """Fitted models are kept per session and data folder: scoring queries share one fit."""
    key = (t.spark.sparkContext.applicationId, folder_state(t.spark, t.dir), name)
    if key not in _MODELS:
        _MODELS[key] = make()
    return _MODELS[key]


def _wind_data(t):
    """The corpus table: built once and read by training, scoring and validation."""
    kept = ["site_id", "valid_time", "target", "power_mw", "denominator_mw", *WIND_FEATURES]
    return _once(t, "wind data", lambda: training.wind_dataset(t.weather.where("tech = 'wind'"), t.hourly, t.sites, columns=kept))


WIND_FEATURES = [
    "horizon_h", "lead_day", "hour_sin", "hour_cos", "wind_speed_10m", "wind_speed_100m", "ws_corrected", "ws_corrected_cube", "cf_powercurve",
    "wdir100_sin", "wdir100_cos", "ws_corrected_lag1", "ws_corrected_lead1", "ws_corrected_roll_mean", "ws_corrected_roll_std",
    "turbulence_intensity", "ws_range_6h", "site_hub_height", "site_specific_power",
]


def _wind_model(t):
    return _once(t, "wind", lambda: training.train_bands(_wind_data(t), WIND_FEATURES, **BAND))


_GROUPS = """
    s AS (SELECT site_id, row_number() OVER (ORDER BY md5(site_id || '#42')) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT site_id FROM x_eval)),
    g AS (SELECT site_id, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'test' WHEN r <= greatest(1, round_even(n * 0.2, 0)) + greatest(1, round_even(n * 0.1, 0)) THEN 'calib' ELSE 'fit' END AS grp FROM s)"""


@query("four_way_split", "L1", "site_id valid_time:t horizon_h:i split", f"""
    WITH {_GROUPS}, c AS (SELECT min(epoch(valid_time)) + (max(epoch(valid_time)) - min(epoch(valid_time))) * 0.875 AS c FROM x_eval e JOIN g ON g.site_id = e.site_id WHERE grp = 'fit')
    SELECT e.site_id, valid_time, horizon_h, CASE WHEN grp <> 'fit' THEN grp WHEN epoch(valid_time) > c.c THEN 'val' ELSE 'train' END AS split FROM x_eval e JOIN g ON g.site_id = e.site_id CROSS JOIN c""")
def _(t):
    return splits.make_split(t.eval)


@query("split_summary", "E38 L1", "split n:i percent:f", f"""
    WITH {_GROUPS}, c AS (SELECT min(epoch(valid_time)) + (max(epoch(valid_time)) - min(epoch(valid_time))) * 0.875 AS c FROM x_eval e JOIN g ON g.site_id = e.site_id WHERE grp = 'fit'),
    z AS (SELECT CASE WHEN grp <> 'fit' THEN grp WHEN epoch(valid_time) > c.c THEN 'val' ELSE 'train' END AS split FROM x_eval e JOIN g ON g.site_id = e.site_id CROSS JOIN c)
    SELECT split, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS percent FROM z GROUP BY 1""")
def _(t):
    return splits.share_summary(splits.make_split(t.eval), "split")


@query("holdout_split", "L2", "site_id valid_time:t horizon_h:i is_holdout:b", """
    SELECT site_id, valid_time, horizon_h, epoch(valid_time) > (SELECT min(epoch(valid_time)) + (max(epoch(valid_time)) - min(epoch(valid_time))) * 0.8 FROM x_eval) AS is_holdout FROM x_eval""")
def _(t):
    return splits.holdout_split(t.eval, 0.2)


@query("forward_folds", "L3", "fold:i role n:i last:t", """
    WITH b AS (SELECT min(epoch(valid_time)) AS lo, max(epoch(valid_time)) AS hi FROM x_eval),
    z AS (SELECT valid_time, (epoch(valid_time) - lo) * 4 / (hi - lo) AS p FROM x_eval CROSS JOIN b)
    SELECT f AS fold, CASE WHEN p <= f + 0.000000001 THEN 'train' ELSE 'valid' END AS role, count(*) AS n, max(valid_time) AS last FROM z CROSS JOIN (VALUES (1), (2), (3)) v(f) WHERE p <= f + 1 + 0.000000001 GROUP BY ALL""")
def _(t):
    folds = splits.forward_folds(t.eval.select("valid_time"), 3)
    return folds.groupBy("fold", "role").agg(F.count("*").alias("n"), F.max("valid_time").alias("last"))


@query("time_blocks", "L4", "o_orderkey:i split", """
    WITH b AS (SELECT max(epoch(o_orderdate)) AS hi, max(epoch(o_orderdate)) - min(epoch(o_orderdate)) AS s FROM orders)
    SELECT o_orderkey, CASE WHEN epoch(o_orderdate) < hi - s * 0.2 - s * 0.1 - s * 0.1 THEN 'train' WHEN epoch(o_orderdate) < hi - s * 0.2 - s * 0.1 THEN 'val' WHEN epoch(o_orderdate) < hi - s * 0.2 THEN 'calib' ELSE 'test' END AS split FROM orders CROSS JOIN b""")
def _(t):
    return splits.time_blocks(t.t("orders").withColumnRenamed("o_orderdate", "valid_time"))


@query("site_folds", "L5", "site_id fold:i", "SELECT site_id, (row_number() OVER (ORDER BY site_id) - 1) % 4 AS fold FROM x_sites")
def _(t):
    return splits.site_folds(t.sites, 4)


@query("leakage_check", "B13 F7", "horizon_h:i rows_checked:i rows_moved:i", """
    SELECT h AS horizon_h, count(*) AS rows_checked, 0 AS rows_moved FROM x_market CROSS JOIN (VALUES (1), (2), (3), (6), (9), (12), (18), (24), (30), (36), (42), (48), (54), (60), (66), (72)) v(h)
    WHERE valid_time - to_hours(CAST(h AS INTEGER)) <= TIMESTAMP '2024-01-16' GROUP BY 1""")
def _(t):
    """Corrupt everything after the cutoff, rebuild, and compare rows issued at or before it."""
    cutoff = F.lit("2024-01-16 00:00:00").cast("timestamp")
    after = F.col("valid_time") > cutoff
    spoiled = t.market_grid.withColumns({c: F.when(after, F.col(c) * 7 + 3).otherwise(F.col(c)) for c in ("demand_mw", "rooftop_pv_mw")})
    keep = [*features.HISTORY_COLUMNS]

    def build(market):
        targets = features.expand_horizons(t.market.select("region", "valid_time"), features.HORIZONS)
        rows = features.at_issue_time(targets, features.load_history(market)).where(F.col("issue_time") <= cutoff)
        return rows.select("region", "valid_time", "horizon_h", *[F.round(c, 6).alias(c) for c in keep])

    clean = build(t.market_grid)
    moved = contracts.differing_rows(clean, build(spoiled)).groupBy("horizon_h").agg(F.count("*").alias("rows_moved"))
    checked = clean.groupBy("horizon_h").agg(F.count("*").alias("rows_checked"))
    return checked.join(moved, "horizon_h", "left").withColumn("rows_moved", F.coalesce("rows_moved", F.lit(0)))


BAND = {"rounds": 10, "depth": 5, "step": 0.3}
FOLD = {"rounds": 5, "depth": 4, "step": 0.3}
_WIND_FIT = sql.fitted("w_", sql.WIND, WIND_FEATURES, **BAND)
_WIND_BAND = f"WITH {_WIND_FIT}, {sql.band_ctes('w_')}"


@query("band_training", "L7", "feature gain:f", f"WITH {_WIND_FIT} SELECT feature, gain FROM w_gain ORDER BY gain DESC LIMIT 20")
def _(t):
    return _wind_model(t).importances(t.spark).orderBy(F.col("gain").desc()).limit(20)


@query("validation_curve", "L7", "level:f round:i n:i loss:f best:b", f"""
    WITH {_WIND_FIT} SELECT a AS level, l.round, n, loss, l.round = b.round AS best FROM w_loss l JOIN w_m USING (m) JOIN w_best b USING (m)""")
def _(t):
    """Loss of every prefix of the ensemble on the validation block, and the one that is kept."""
    data = training._learnable(_wind_data(t).where("split = 'val'"), WIND_FEATURES, "target")
    trees = _wind_model(t).trees
    rows = data.select(F.col("target").alias("y"), F.array(F.lit(boosting.VALID)).alias("roles"), boosting.binned(data, WIND_FEATURES, trees.edges).alias("bins"))
    losses = boosting.staged_loss(rows, trees)
    kept = F.get(F.array(*map(F.lit, trees.kept)), F.col("m"))
    return losses.select(boosting.level_of(trees, F.col("m")).alias("level"), "round", "n", "loss", (F.col("round") == kept).alias("best"))


@query("band_scoring", "L8 C24 D18", "site_id valid_time:t horizon_h:i split p10_mw:f p50_mw:f p90_mw:f", f"{_WIND_BAND} SELECT * FROM w_out")
def _(t):
    return training.score_bands(_wind_data(t), _wind_model(t))


SOLAR_FEATURES = [
    "horizon_h", "lead_day", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "ghi_wm2", "cloud_total", "cloud_low", "temp_2m_c", "wind_speed_10m", "solar_elevation", "clearsky_ghi",
    "poa_nwp", "cell_temp_c", "kt_nwp", "physics_cf", "clearsky_cf", "physics_over_clearsky",
    *[f"{c}_{k}" for c in ("ghi_wm2", "cloud_total") for k in ("lag1", "lead1", "lag3", "lead3", "roll_mean", "roll_std", "delta")],
    "site_latitude", "site_tilt", "site_azimuth_sin", "site_azimuth_cos", "site_capacity_mw",
]
_SOLAR_BAND = f"WITH {sql.fitted('s_', sql.SOLAR, SOLAR_FEATURES, **BAND)}, {sql.band_ctes('s_', 'clearsky_mw')}"


def _solar_data(t):
    return _once(t, "solar data", lambda: materialise(training.solar_dataset(t.weather.where("tech = 'solar'"), t.hourly, t.sites)))


def _solar_model(t):
    return _once(t, "solar", lambda: training.train_bands(_solar_data(t), SOLAR_FEATURES, **BAND))


@query("solar_band_scoring", "L7 L8 C23", "site_id valid_time:t horizon_h:i split p10_mw:f p50_mw:f p90_mw:f clearsky_mw:f", f"{_SOLAR_BAND} SELECT * FROM s_out")
def _(t):
    return training.score_bands(_solar_data(t), _solar_model(t))


def _demand_data(t):
    centre = keep_one(t.weather.where("horizon_h = 24").select("region", "valid_time", "site_id", "temp_2m_c", "cloud_total", "wind_speed_10m", "ghi_wm2"),
                      ["region", "valid_time"], ["site_id"]).drop("site_id")
    return training.demand_dataset(t.market_grid, centre, REGION_CLOCKS, features.HORIZONS, sorted(REGION_CLOCKS))


DEMAND_FEATURES = [
    "temp_2m_c", "cloud_total", "wind_speed_10m", "ghi_wm2", "cooling_degrees", "heating_degrees", "cooling_degrees_24h", "hour_sin", "hour_cos", "doy_sin", "doy_cos", "dow_sin", "dow_cos",
    "is_weekend", "is_holiday", "horizon_h", "lead_day", *features.HISTORY_COLUMNS, "region_peak_mw", *[f"region_{r}" for r in sorted(REGION_CLOCKS)],
]


@query("demand_scoring", "L9 L7 C30", "region valid_time:t horizon_h:i split p10_mw:f p50_mw:f p90_mw:f actual_mw:f", sql.demand_bands(DEMAND_FEATURES, sorted(REGION_CLOCKS), **BAND))
def _(t):
    data = _once(t, "demand data", lambda: materialise(_demand_data(t)))
    # A feature that never changes on the training rows (a holiday flag over a fortnight) is left out, any other is used.
    fixed = {r.column for r in features.constant_columns(data.where("split = 'train'"), DEMAND_FEATURES).collect()}
    model = _once(t, "demand", lambda: training.train_bands(data, [c for c in DEMAND_FEATURES if c not in fixed], **BAND))
    return training.score_demand(data, model)


def _evaluated(data, model, grid, tech, physics):
    """Scored rows with truth and the state at issue; for solar the clear sky at issue and at the hour itself."""
    scored = training.score_bands(data, model).where(F.col("power_mw").isNotNull())
    clear = F.col("clearsky_mw") if tech == "solar" else F.col("denominator_mw")
    scored = scored.select("site_id", "valid_time", "horizon_h", "split", F.lit(tech).alias("tech"), "p10_mw", "p50_mw", "p90_mw",
                           F.col("power_mw").alias("actual_mw"), F.col("denominator_mw").alias("capacity_mw"), clear.alias("clearsky_mw"),
                           (F.col(physics) * F.col("denominator_mw")).alias("physics_mw"))
    measured = grid.where(F.col("tech") == tech).select("site_id", "valid_time", "power_mw")
    if tech == "solar":
        sky = data.groupBy("site_id", "valid_time").agg(F.max("clearsky_mw").alias("clearsky_mw"))
        measured = measured.join(sky, ["site_id", "valid_time"], "left")
    else:
        measured = measured.withColumn("clearsky_mw", F.lit(0.0))
    return training.evaluation_frame(scored.drop("physics_mw"), measured, scored.select("site_id", "valid_time", "horizon_h", "physics_mw"))


def _wind_evaluated(t):
    return _once(t, "evaluated", lambda: materialise(_evaluated(_wind_data(t), _wind_model(t), t.grid, "wind", "cf_powercurve")))


def _solar_evaluated(t):
    return _once(t, "solar evaluated", lambda: materialise(_evaluated(_solar_data(t), _solar_model(t), t.grid, "solar", "physics_cf")))


_WIND_EVAL = f"{_WIND_BAND}, {sql.evaluated('w_', 'wind', 'cf_powercurve', None)}"
_SOLAR_EVAL = f"{_SOLAR_BAND}, {sql.evaluated('s_', 'solar', 'physics_cf', 'clearsky_mw')}"


@query("evaluation_frame", "L10", "site_id valid_time:t horizon_h:i is_holdout:b p50_mw:f actual_mw:f physics_mw:f power_at_issue_mw:f", f"{_WIND_EVAL} SELECT * FROM w_ev")
def _(t):
    return _wind_evaluated(t)


@query("solar_evaluation", "L10", "site_id valid_time:t horizon_h:i is_holdout:b p50_mw:f actual_mw:f physics_mw:f power_at_issue_mw:f clearsky_mw:f clearsky_at_issue_mw:f",
       f"{_SOLAR_EVAL} SELECT *, clear_now AS clearsky_mw, clear_at_issue AS clearsky_at_issue_mw FROM s_ev")
def _(t):
    return _solar_evaluated(t)


@query("model_benchmark", "L14 E20", "method lead_bucket n:i nmae_pct:f nrmse_pct:f bias_pct:f skill:f", f"{_WIND_EVAL}, {sql.benchmark('w_')}")
def _(t):
    return training.benchmark_report(training.with_baselines(_wind_evaluated(t)))


@query("solar_benchmark", "L14 F19 E20", "method lead_bucket n:i nmae_pct:f nrmse_pct:f bias_pct:f skill:f", f"{_SOLAR_EVAL}, {sql.benchmark('s_')}")
def _(t):
    """Every method on held-out solar hours; smart persistence holds the clear-sky index of the issue hour."""
    return training.benchmark_report(training.with_baselines(_solar_evaluated(t)))


@query("baseline_benchmark", "L14 E20 F19 E37", "method lead_bucket n:i nmae_pct:f skill:f", """
    WITH c AS (SELECT min(epoch(valid_time)) + (max(epoch(valid_time)) - min(epoch(valid_time))) * 0.8 AS c FROM x_eval),
    tr AS (SELECT e.* FROM x_eval e CROSS JOIN c WHERE epoch(valid_time) <= c.c), a AS (SELECT site_id, (dayofyear(valid_time) - 1) // 15 AS b, hour(valid_time) AS h, avg(actual_mw) AS m FROM tr GROUP BY ALL),
    s AS (SELECT site_id, avg(actual_mw) AS m FROM tr GROUP BY 1),
    z AS (SELECT e.*, coalesce(h.power_mw, 0) AS pers, coalesce(a.m, s.m, 0) AS clim FROM x_eval e CROSS JOIN c LEFT JOIN x_hourly h ON h.site_id = e.site_id AND h.valid_time = e.issue_time
        LEFT JOIN a ON a.site_id = e.site_id AND a.b = (dayofyear(e.valid_time) - 1) // 15 AND a.h = hour(e.valid_time) LEFT JOIN s ON s.site_id = e.site_id WHERE epoch(e.valid_time) > c.c),
    l AS (SELECT *, CASE horizon_h WHEN 24 THEN '1-24h' WHEN 48 THEN '25-48h' ELSE '49-72h' END AS b FROM z), k AS (SELECT b AS lead_bucket, * FROM l UNION ALL SELECT 'all', * FROM l),
    m AS (SELECT 'persistence' AS method, lead_bucket, pers AS p, actual_mw, capacity_mw FROM k UNION ALL SELECT 'climatology', lead_bucket, clim, actual_mw, capacity_mw FROM k UNION ALL SELECT 'band', lead_bucket, p50_mw, actual_mw, capacity_mw FROM k),
    r AS (SELECT method, lead_bucket, count(*) AS n, avg(abs(p - actual_mw) / capacity_mw) * 100 AS nmae_pct FROM m GROUP BY ALL)
    SELECT r.*, 1 - r.nmae_pct / q.nmae_pct AS skill FROM r JOIN r q ON q.lead_bucket = r.lead_bucket AND q.method = 'persistence'""")
def _(t):
    measured = t.grid.select("site_id", "valid_time", "power_mw", F.lit(1.0).alias("clearsky_mw"))
    rows = t.eval.withColumn("clearsky_mw", F.col("capacity_mw"))
    frame = training.evaluation_frame(rows, measured, rows.select("site_id", "valid_time", "horizon_h", F.col("p90_mw").alias("physics_mw")))
    return training.benchmark_report(training.with_baselines(frame), {"band": "p50_mw", "persistence": "persistence_mw", "climatology": "climatology_mw"})


@query("leave_sites_out", "L11 E35", "site_id n:i nmae_pct:f bias_pct:f", f"""
    WITH {sql.split_ctes('f_', sql.WIND)}, {sql.fold_ctes('f_', WIND_FEATURES, 8, **FOLD)}
    SELECT site_id, {sql.METRICS} FROM (SELECT site_id, p50_mw AS p, power_mw AS actual_mw, denominator_mw AS capacity_mw FROM f_out WHERE power_mw IS NOT NULL) z GROUP BY 1""")
def _(t):
    # Scored rows go straight into the metrics, the only ones to read them.
    scored = _once(t, "lso", lambda: training.leave_sites_out(_wind_data(t), WIND_FEATURES, 8, **FOLD))
    rows = scored.where(F.col("power_mw").isNotNull()).select("site_id", F.col("power_mw").alias("actual_mw"), F.col("denominator_mw").alias("capacity_mw"), "p50_mw")
    return metrics.score(rows, ["site_id"])


@query("band_coverage", "E24 E44", "lead_bucket n:i nmae_pct:f coverage:f mean_width:f", f"""
    {_WIND_BAND}, z AS (SELECT *, {sql.BUCKET} AS b, power_mw AS y_mw, denominator_mw AS c FROM w_out WHERE split = 'test' AND power_mw IS NOT NULL)
    SELECT lead_bucket, count(*) AS n, avg(abs(p50_mw - y_mw) / c) * 100 AS nmae_pct, avg(CASE WHEN y_mw >= p10_mw AND y_mw <= p90_mw THEN 1.0 ELSE 0 END) AS coverage, avg((p90_mw - p10_mw) / c) AS mean_width
    FROM (SELECT b AS lead_bucket, * FROM z UNION ALL SELECT 'all', * FROM z) q GROUP BY 1""")
def _(t):
    scored = training.score_bands(_wind_data(t).where("split = 'test'"), _wind_model(t)).where(F.col("power_mw").isNotNull())
    return metrics.by_lead_bucket(scored.withColumns({"actual_mw": F.col("power_mw"), "capacity_mw": F.col("denominator_mw")}))


_LEADS_FIT = sql.fit_ctes("c_", WIND_FEATURES, sql.LEVELS, [sql.SPLIT_ROLES[0], f"CASE WHEN horizon_h = 24 THEN {sql.SPLIT_ROLES[0]} ELSE 0 END"], **BAND)


@query("lead_comparison", "E36", "lead_bucket n:i current_nmae:f baseline_nmae:f gain_pp:f", f"""
    WITH {sql.split_ctes('c_', sql.WIND)}, {sql.source_cte('c_', WIND_FEATURES)}, {_LEADS_FIT}, c_band AS MATERIALIZED ({sql.sorted_band('c_')}),
    z AS (SELECT {sql.BUCKET} AS lead_bucket, abs(a.p50 - y) AS now, abs(b.p50 - y) AS old FROM c_src s JOIN c_band a ON a.id = s.id AND a.g = 0 JOIN c_band b ON b.id = s.id AND b.g = 1 WHERE split = 'test' AND y IS NOT NULL)
    SELECT lead_bucket, count(*) AS n, avg(now) * 100 AS current_nmae, avg(old) * 100 AS baseline_nmae, avg(old) * 100 - avg(now) * 100 AS gain_pp FROM z GROUP BY 1""")
def _(t):
    """A model that learned from every lead against one that learned from the day-ahead lead only, on the same held-out rows."""
    role = F.coalesce(*[F.when(F.col("split") == k, v) for k, v in training.ROLES.items()], F.lit(boosting.IDLE))
    roles = F.array(role, F.when(F.col("horizon_h") == 24, role).otherwise(F.lit(boosting.IDLE)))
    data = materialise(training._learnable(_wind_data(t), WIND_FEATURES, "target").withColumn("roles", roles))
    trees = boosting.fit(data, WIND_FEATURES, training.LEVELS, groups=2, **BAND)

    def held_out(group):
        rows = training.with_raw_band(data.where("split = 'test'"), trees, F.lit(group))
        return rows.select("site_id", "valid_time", "horizon_h", F.col("p50").alias("p50_mw"), F.col("target").alias("actual_mw"), F.lit(1.0).alias("capacity_mw"))

    return metrics.compare_models(held_out(0), held_out(1), ["site_id", "valid_time", "horizon_h"])
