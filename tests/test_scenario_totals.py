"""Regional totals against a loop over windows, scenarios and sites, with repeated and unknown rows."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gridloom.operators import scenarios

T0 = datetime(2024, 1, 1)


def clipped(p, cap):
    low = max(p, 0.0) if p is not None else 0.0
    return low if cap is None else min(low, cap)


@pytest.mark.parametrize("most", [400_000, 40])
def test_totals_equal_a_loop(spark, monkeypatch, most):
    monkeypatch.setattr(scenarios, "GROUP_ROWS", most)
    rows = []
    for s, site in enumerate(["a", "b", "c", "d", None]):
        for h in range(24 * 12):
            p, cap = float((h * 7 + s * 13) % 50), None if s == 2 and h % 5 == 0 else 60.0 + s
            error = None if (h + s) % 11 == 0 else ((h * 3 + s * 5) % 17 - 8) / 10.0
            rows.append(("R", T0 + timedelta(hours=h), site, p, cap, error))
            if site == "b" and h % 9 == 0:
                rows.append(("R", T0 + timedelta(hours=h), site, p + 1, 70.0, 0.25))
    store = spark.createDataFrame(rows, "region string, valid_time timestamp, site_id string, p50_mw double, capacity_mw double, residual double")
    starts = [T0 + timedelta(days=2), T0 + timedelta(days=3)]
    windows = spark.createDataFrame([("R", w) for w in starts], "region string, window_start timestamp")
    picks = [("R", w, k, T0 + timedelta(days=6 + k % 3)) for w in starts for k in range(4)]
    blocks = spark.createDataFrame(picks, "region string, window_start timestamp, scenario int, block_start timestamp")
    hours = scenarios.window_hours(windows, store, 30)
    factors = [0.5, 2.0]
    got = scenarios.regional_scenarios(hours, blocks, store, 30, factors=factors)
    total = {(r.window_start, r.scenario, r.offset, r.dispersion): r.renewable_mw for r in got.collect()}
    assert len(total) == got.count() == 2 * 4 * 30 * 2
    for _, w, k, b in picks:
        for o in range(30):
            now = [r for r in rows if r[1] == w + timedelta(hours=o)]
            then = [r for r in rows if r[1] == b + timedelta(hours=o) and r[5] is not None]
            for d in factors:
                want = sum(clipped(r[3], r[4]) for r in now)
                for r in now:
                    for e in then:
                        if r[2] is not None and r[2] == e[2]:
                            moved = None if r[4] is None else r[3] + d * e[5] * r[4]
                            want += clipped(moved, r[4]) - clipped(r[3], r[4])
                assert total[w, k, o, d] == pytest.approx(want, abs=1e-9)
    # Errors are not multiplied out by window and scenario in a join.
    plan = scenarios.regional_scenarios(hours, blocks, store, 30).select(F.sum("renewable_mw"))._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan


def test_site_members_and_bands_equal_a_loop(spark):
    rows = []
    for s, site in enumerate(["a", "b", "c", None]):
        for h in range(24 * 12):
            p, cap = None if s == 0 and h % 7 == 0 else float((h * 7 + s * 13) % 50), None if s == 2 and h % 5 == 0 else 60.0 + s
            error = None if (h + s) % 11 == 0 else ((h * 3 + s * 5) % 17 - 8) / 10.0
            rows.append(("R", T0 + timedelta(hours=h), site, p, cap, error))
            if site == "b" and h % 9 == 0:
                rows.append(("R", T0 + timedelta(hours=h), site, p + 1, 70.0, 0.25))
    rows += [("R", T0 + timedelta(hours=h), "old", 1.0, 9.0, 0.1) for h in range(24)]
    store = spark.createDataFrame(rows, "region string, valid_time timestamp, site_id string, p50_mw double, capacity_mw double, residual double")
    # Blocks may also reach past the store, where nothing is known.
    starts = [T0 + timedelta(days=2), T0 + timedelta(days=3)]
    picks = [("R", w, k, T0 + timedelta(days=6 + 2 * (k % 4))) for w in starts for k in range(7)]
    windows = spark.createDataFrame([("R", w) for w in starts], "region string, window_start timestamp")
    blocks = spark.createDataFrame(picks, "region string, window_start timestamp, scenario int, block_start timestamp")
    hours = scenarios.window_hours(windows, store, 30).withColumns({"p10_mw": F.col("p50_mw") - 9, "p90_mw": F.col("p50_mw") + 9, "actual_mw": F.col("p50_mw") + 3})
    wanted = []
    for _, w, k, b in picks:
        for o in range(30):
            at = w + timedelta(hours=o)
            for _, t, site, p, cap, _ in rows:
                if t == at:
                    found = [r[5] for r in rows if site and r[1:3] == (b + timedelta(hours=o), site) and r[5] is not None] or [0.0]
                    wanted += [("R", w, k, o, at, site, clipped(None if p is None or cap is None else p + 1.3 * e * cap, cap)) for e in found]
    made = scenarios.site_scenarios(hours, blocks, store, 30, 1.3)
    order = lambda x: tuple(map(str, x))
    assert sorted(map(tuple, made.collect()), key=order) == sorted(wanted, key=order)
    packed = scenarios.site_scenarios(hours, blocks, store, 30, 1.3, packed=True)
    keys = [*scenarios.WINDOW_KEYS, "offset", "site_id"]
    one, two = (sorted(map(tuple, scenarios.ensemble_quantiles(f, keys, "mw").collect()), key=order) for f in (made, packed))
    assert [x[:4] + x[5:] for x in one] == [x[:4] + x[5:] for x in two]
    assert [x[4] for x in one] == pytest.approx([x[4] for x in two])
    assert sorted(scenarios.site_coverage(hours, made).collect()) == sorted(scenarios.site_coverage(hours, packed).collect())
    # No row of a site and scenario is joined.
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "scenario" in line]
