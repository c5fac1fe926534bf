"""SQL of the solar estimate: sun, clear sky, irradiance on the panel, cell temperature and AC power."""

from __future__ import annotations


def _sun(ts: str) -> tuple[str, str]:
    """Declination and hour angle at a stamp, in radians."""
    b = f"radians((dayofyear({ts}) - 81) * 360 / 364.0)"
    eot = f"(sin({b} * 2) * 9.87 - cos({b}) * 7.53 - sin({b}) * 1.5)"
    return f"radians(sin(radians((dayofyear({ts}) + 284) * 360 / 365.0)) * 23.45)", f"radians((hour({ts}) + minute({ts}) / 60.0 + longitude / 15 + {eot} / 60 - 12) * 15)"


def panel(source: str, ts: str, ghi: str, wind: str, tracking: bool = False) -> str:
    """``source`` (latitude, longitude, tilt, azimuth, temp_2m_c, capacity_mw) with sun, irradiance, cell and AC power, stage by stage."""
    dec, angle = _sun(ts)
    stages = [
        f"{dec} AS dec, {angle} AS ang",
        "sin(radians(latitude)) * sin(dec) + cos(radians(latitude)) * cos(dec) * cos(ang) AS up, cos(radians(latitude)) * sin(dec) - sin(radians(latitude)) * cos(dec) * cos(ang) AS north, -cos(dec) * sin(ang) AS east",
        "CASE WHEN up > 0.001 THEN up * 1098 * exp(-0.057 / up) ELSE 0 END AS clear",
        f"{ghi} AS ghi",
        "least(greatest(CASE WHEN up > 0.065 THEN ghi / (up * 1366.1) ELSE 0 END, 0), 1) AS kt",
        "CASE WHEN kt <= 0.22 THEN 1 - kt * 0.09 WHEN kt <= 0.80 THEN ((kt * 12.336 - 16.638) * kt + 4.388) * kt * kt - kt * 0.1604 + 0.9511 ELSE 0.165 END AS df, "
        "greatest(0, sin(radians(tilt)) * sin(radians(azimuth)) * east + sin(radians(tilt)) * cos(radians(azimuth)) * north + cos(radians(tilt)) * up) AS aoi",
        "CASE WHEN up > 0.065 THEN ghi * (1 - df) / up ELSE 0 END * aoi + ghi * df * (cos(radians(tilt)) + 1) / 2 + ghi * (1 - cos(radians(tilt))) * 0.125 AS poa",
        f"temp_2m_c + poa / (greatest({wind}, 0) * 6.84 + 25) AS cell",
        "coalesce(least(greatest(capacity_mw * ratio * poa / 1000 * ((cell - 25) * -0.004 + 1) * 0.96, 0), capacity_mw), 0) AS ac",
    ]
    if tracking:  # panels with ``mount`` single_axis turn on a level axis, back with a low sun
        turn = ["atan2(-east, up) AS ideal", "abs(cos(ideal)) / 0.35 AS shaded",
                "CASE WHEN up > 0 THEN least(greatest(CASE WHEN shaded < 1 THEN ideal - sign(ideal) * acos(least(shaded, 1)) ELSE ideal END, -1.0471975511965976), 1.0471975511965976) ELSE 0 END AS turn"]
        fixed = "sin(radians(tilt)) * sin(radians(azimuth)) * east + sin(radians(tilt)) * cos(radians(azimuth)) * north + cos(radians(tilt)) * up"
        stages[5] = stages[5].replace(fixed, f"CASE WHEN mount = 'single_axis' THEN sin(turn) * -east + cos(turn) * up ELSE {fixed} END") + ", CASE WHEN mount = 'single_axis' THEN abs(turn) ELSE radians(tilt) END AS lean"
        stages[6] = stages[6].replace("radians(tilt)", "lean")
        stages[2:2] = turn
    for i, s in enumerate(stages):
        source = f"SELECT *, {s} FROM ({source}) p{i}"
    return source


def clear_power(source: str, keys: str = "site_id, ts, horizon_h, ratio", tracking: bool = False) -> str:
    """(keys, clear_ac): the mean AC power of six sub-hours under clear sky."""
    subs = f"SELECT *, ts + to_minutes(k * 10 - 55) AS sub FROM ({source}) c CROSS JOIN range(6) k(k)"
    return f"SELECT {keys}, sum(ac) / 6 AS clear_ac FROM ({panel(subs, 'sub', 'clear', '1', tracking)}) q GROUP BY ALL"


_PANEL_ROWS = """SELECT w.site_id, w.valid_time AS ts, w.horizon_h, w.ghi_wm2, w.temp_2m_c, w.wind_speed_10m, w.cloud_total, w.cloud_low, s.capacity_mw, s.latitude, s.longitude, s.tilt_deg, s.azimuth_deg,
    CAST(1.25 AS DOUBLE) AS ratio, coalesce(s.tilt_deg, least(abs(s.latitude), 40)) AS tilt, coalesce(s.azimuth_deg, CASE WHEN s.latitude >= 0 THEN 180 ELSE 0 END) AS azimuth
    FROM x_weather w JOIN x_sites s ON s.site_id = w.site_id WHERE w.tech = 'solar'"""
SOLAR_ESTIMATE = f"""
    SELECT q.*, ts AS valid_time, c.clear_ac, ac / capacity_mw AS physics_cf, c.clear_ac / capacity_mw AS clearsky_cf, CASE WHEN c.clear_ac > 0.001 THEN ac / c.clear_ac ELSE 0 END AS physics_over_clearsky,
        least(greatest(CASE WHEN clear > 1 THEN ghi / clear ELSE 0 END, 0), 1.5) AS kt_nwp, degrees(asin(least(greatest(up, -1), 1))) AS solar_elevation, 90 - degrees(asin(least(greatest(up, -1), 1))) AS solar_zenith,
        clear AS clearsky_ghi, poa AS poa_nwp, cell AS cell_temp_c
    FROM ({panel(_PANEL_ROWS, 'ts', 'greatest(ghi_wm2, 0)', 'wind_speed_10m')}) q JOIN ({clear_power(_PANEL_ROWS)}) c USING (site_id, ts, horizon_h)"""

_GRID_ROWS = """SELECT h.site_id, h.valid_time AS ts, CAST(25 AS DOUBLE) AS temp_2m_c, s.capacity_mw, s.latitude, s.longitude, mount, ratio, coalesce(s.tilt_deg, least(abs(s.latitude), 40)) AS tilt,
    coalesce(s.azimuth_deg, CASE WHEN s.latitude >= 0 THEN 180 ELSE 0 END) AS azimuth FROM (SELECT DISTINCT site_id, valid_time FROM x_hourly WHERE tech = 'solar') h JOIN x_sites s ON s.site_id = h.site_id
    CROSS JOIN (VALUES ('fixed'), ('single_axis')) m(mount) CROSS JOIN (SELECT CAST(r AS DOUBLE) AS ratio FROM (VALUES (1.1), (1.25), (1.4), (1.6), (1.8), (2.1), (2.5)) r(r)) r"""
PLANT_FIT = f"""
    WITH o AS (SELECT site_id, month(valid_time) AS m, hour(valid_time) AS h, quantile_cont(power_mw, 0.98) AS seen FROM x_hourly WHERE tech = 'solar' GROUP BY ALL HAVING count(power_mw) >= 5),
    c AS (SELECT site_id, mount, ratio, capacity_mw, month(ts) AS m, hour(ts) AS h, max(clear_ac) AS made FROM ({clear_power(_GRID_ROWS, 'site_id, ts, mount, ratio, capacity_mw', True)}) z GROUP BY ALL),
    e AS (SELECT site_id, mount, ratio, capacity_mw, sqrt(avg((seen - made) * (seen - made))) AS rmse_mw FROM o JOIN c USING (site_id, m, h) GROUP BY ALL)
    SELECT site_id, mount, ratio AS dc_ac_ratio, rmse_mw, rmse_mw / capacity_mw * 100 AS rmse_pct_capacity FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY round(rmse_mw, 9), mount, ratio) AS i FROM e) z WHERE i = 1"""
