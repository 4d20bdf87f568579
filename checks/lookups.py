"""J, W and L: lookups, windows and top-k reads."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.fx import END, START, as_of, doubles, query, r, raw, sql, table
from sparkmos import settings as cfg
from sparkmos.functions.common import ts
from sparkmos.operators import alerts, asof, crossval, health, nearest, serve, spatial, verify
from sparkmos.plans import evaluation, features, spine

TB = ["id"]
FCOLS = ["id", "wind_speed_kn", "wind_dir_deg", "pressure_msl"]
# Every hour of the month at every point.
SPINE = """spine AS (SELECT p.point_id, p.idx, p.lat, p.lon, t FROM fx_points p CROSS JOIN range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1' HOUR) g(t))"""
OP_SPINE = SPINE.replace("FROM fx_points p", "FROM (SELECT * FROM fx_points WHERE is_operational) p")


def full_spine(spark, sf, operational=False):
    p = table(spark, sf, "fx_points")
    if operational:
        p = p.filter("is_operational")
    return spine.hourly_spine(p, ts(START), ts(END))


def lookup_sql(window: int, src: str = "spine", causal: bool = False, name: str = "found") -> str:
    """Direct form: every forecast whose minute difference fits, ranked per model."""
    extra = "AND date_diff('minute', f.valid_time, s.t) >= 0" if causal else ""
    return f"""{name} AS (SELECT * FROM (SELECT s.point_id, s.t, f.* EXCLUDE (point_id),
  row_number() OVER (PARTITION BY s.point_id, s.t, f.model_name ORDER BY f.run_time DESC, abs(date_diff('minute', f.valid_time, s.t)), f.valid_time, f.id DESC) AS rn
  FROM {src} s JOIN fx_forecast_runs f ON f.point_id = s.point_id AND f.valid_time BETWEEN s.t - INTERVAL '{window + 1}' MINUTE AND s.t + INTERVAL '{window + 1}' MINUTE
  WHERE abs(date_diff('minute', f.valid_time, s.t)) <= {window} {extra}) WHERE rn = 1)"""


@query("j01_forecast_asof", sql(f"WITH {SPINE}, {lookup_sql(90)} SELECT point_id, t, model_name, run_time, valid_time, id, {doubles('wind_speed_kn wind_dir_deg pressure_msl')} FROM found", "fx_forecast_runs"))
def j01(spark, sf):
    f = table(spark, sf, "fx_forecast_runs")
    return asof.forecasts_at(full_spine(spark, sf), f, FCOLS, 90, tie_break=TB).select("point_id", "t", "model_name", "run_time", "valid_time", *FCOLS)


@query("j02_observation_lookback", sql(f"""WITH times AS (SELECT * FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1' HOUR) g(t))
SELECT t + INTERVAL '90' SECOND AS t, o.id, o.source, o.timestamp FROM times JOIN fx_observations o
ON o.timestamp <= t + INTERVAL '90' SECOND AND o.timestamp >= date_trunc('minute', t + INTERVAL '90' SECOND) - INTERVAL '60' MINUTE""", "fx_observations"))
def j02(spark, sf):
    """At 1.5 minutes past every hour, so that the truncation of the lower bound shows."""
    times = full_spine(spark, sf).select((F.col("t") + F.expr("INTERVAL '90' SECOND")).alias("t"))
    return nearest.observations_before(times, table(spark, sf, "fx_observations"), 60).select("t", "id", "source", "timestamp")


DIST = "2 * 6371 * asin(sqrt(pow(sin(radians(o.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(o.lat)) * pow(sin(radians(o.lon - s.lon) / 2), 2)))"


def nearest_sql(lo: int, hi: int, src: str = "spine", name: str = "near") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT s.point_id, s.t, o.* EXCLUDE (lat, lon), {DIST} AS dist_km, date_diff('microsecond', o.timestamp, s.t) / 60e6 AS age_min,
  row_number() OVER (PARTITION BY s.point_id, s.t ORDER BY {DIST}, o.timestamp DESC, o.source, o.id DESC) AS rn
  FROM {src} s JOIN fx_observations o ON o.timestamp <= s.t - INTERVAL '{lo}' MINUTE AND o.timestamp >= s.t - INTERVAL '{hi}' MINUTE) WHERE rn = 1)"""


@query("j03_nearest_station", sql(f"WITH {SPINE}, {nearest_sql(0, 60)} SELECT point_id, t, id, source, timestamp, {doubles('wind_speed_kn wind_dir_deg wind_gust_kn dist_km age_min')} FROM near", "fx_points", "fx_observations"))
def j03(spark, sf):
    return nearest.nearest_observation(
        full_spine(spark, sf), table(spark, sf, "fx_observations"), cfg.POINTS, max_age_min=60,
        payload=["id", *nearest.PAYLOAD], tie_break=TB,
    )


TARGETS = """targets AS (SELECT point_id, t AS target FROM fx_points CROSS JOIN range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1' HOUR) g(t))"""
PRED_AT = """found AS (SELECT * FROM (SELECT q.*, p.* EXCLUDE (point_id), abs(date_diff('microsecond', p.valid_time, q.target)) / 1e6 AS diff_s,
  row_number() OVER (PARTITION BY q.point_id, q.target ORDER BY abs(date_diff('microsecond', p.valid_time, q.target)), p.generated_at DESC, p.valid_time, p.id DESC) AS rn
  FROM targets q JOIN fx_predictions p ON p.point_id = q.point_id AND p.valid_time BETWEEN q.target - INTERVAL '1' HOUR AND q.target + INTERVAL '1' HOUR) WHERE rn = 1)"""


def targets_df(spark, sf):
    return full_spine(spark, sf).select("point_id", F.col("t").alias("target"))


@query("j04_prediction_at", sql(f"WITH {TARGETS}, {PRED_AT} SELECT point_id, target, id, valid_time, {doubles('wind_speed_kn diff_s')} FROM found", "fx_predictions"))
def j04(spark, sf):
    return serve.prediction_at(targets_df(spark, sf), table(spark, sf, "fx_predictions"), ["point_id", "target"], TB).select(
        "point_id", "target", "id", "valid_time", "wind_speed_kn", "diff_s"
    )


PAIRS = """times AS (SELECT DISTINCT valid_time FROM fx_predictions),
obs_at AS (SELECT * FROM (SELECT v.valid_time, o.timestamp AS obs_time, o.source AS obs_source, o.wind_speed_kn AS obs_speed, o.wind_dir_deg AS obs_dir,
  row_number() OVER (PARTITION BY v.valid_time ORDER BY abs(date_diff('microsecond', o.timestamp, v.valid_time)), o.timestamp DESC, o.source, o.id DESC) AS rn
  FROM times v JOIN fx_observations o ON o.timestamp BETWEEN v.valid_time - INTERVAL '1' HOUR AND v.valid_time + INTERVAL '1' HOUR) WHERE rn = 1),
pairs AS (SELECT p.*, o.* EXCLUDE (valid_time, rn), p.wind_speed_kn - obs_speed AS error, abs(p.wind_speed_kn - obs_speed) AS abs_error,
  CASE WHEN abs(p.wind_dir_deg - obs_dir) > 180 THEN 360 - abs(p.wind_dir_deg - obs_dir) ELSE abs(p.wind_dir_deg - obs_dir) END AS dir_error,
  contains(obs_source, 'era5') AS is_reanalysis FROM fx_predictions p JOIN obs_at o USING (valid_time))"""


def pairs_df(spark, sf):
    return verify.matched_pairs(table(spark, sf, "fx_predictions"), table(spark, sf, "fx_observations"), tie_break=TB)


@query("j05_verification_pairs", sql(f"WITH {PAIRS} SELECT id, point_id, valid_time, obs_time, obs_source, {doubles('error abs_error dir_error')}, is_reanalysis FROM pairs", "fx_predictions", "fx_observations"))
def j05(spark, sf):
    return pairs_df(spark, sf).select("id", "point_id", "valid_time", "obs_time", "obs_source", "error", "abs_error", "dir_error", "is_reanalysis")


@query("j06_persistence", sql(f"WITH {OP_SPINE}, {nearest_sql(30, 120)} SELECT point_id, t AS valid_time, {r('wind_speed_kn')} AS pers_speed, {r('wind_dir_deg')} AS pers_dir FROM near", "fx_points", "fx_observations"))
def j06(spark, sf):
    s = full_spine(spark, sf, True).select("point_id", F.col("t").alias("valid_time"))
    return evaluation.persistence(s, table(spark, sf, "fx_observations"), cfg.OPERATIONAL, TB)


M2 = ("icon_eu", "gfs_seamless")
J7 = sql(f"""WITH {SPINE}, {lookup_sql(30)},
a AS (SELECT * FROM found WHERE model_name = '{M2[0]}'), b AS (SELECT * FROM found WHERE model_name = '{M2[1]}')
SELECT a.point_id, a.t, {r('abs(a.wind_speed_kn - b.wind_speed_kn)')} AS agree_speed, {r('abs(a.pressure_msl - b.pressure_msl)')} AS agree_press,
  {r('abs(a.temperature_2m - b.temperature_2m)')} AS agree_temp,
  {r('CASE WHEN abs(a.wind_dir_deg - b.wind_dir_deg) > 180 THEN 360 - abs(a.wind_dir_deg - b.wind_dir_deg) ELSE abs(a.wind_dir_deg - b.wind_dir_deg) END')} AS agree_dir
FROM a LEFT JOIN b USING (point_id, t)""", "fx_forecast_runs")


@query("j07_model_agreement", J7)
def j07(spark, sf):
    f = features.forecast_features(full_spine(spark, sf), table(spark, sf, "fx_forecast_runs"), tie_break=TB)
    return f.select("point_id", "t", *[F.col(f"agree_{x}_{M2[0]}_{M2[1]}").alias(f"agree_{x}") for x in ("speed", "press", "temp", "dir")])


@query("j08_daily_pair_join", sql(f"""WITH z AS (SELECT timestamp::DATE AS d, avg(pressure_msl) AS p FROM fx_climatology WHERE point_id = 'zurich' GROUP BY 1),
m AS (SELECT timestamp::DATE AS d, avg(pressure_msl) AS p FROM fx_climatology WHERE point_id = 'milano_linate' GROUP BY 1)
SELECT CAST(d AS VARCHAR) AS day, {r('z.p - m.p')} AS gradient FROM z JOIN m USING (d)""", "fx_climatology"))
def j08(spark, sf):
    c = table(spark, sf, "fx_climatology").filter("point_id IN ('zurich', 'milano_linate')")
    mean = lambda p: F.avg(F.when(F.col("point_id") == p, F.col("pressure_msl")))
    return c.groupBy(F.to_date("timestamp").alias("day")).agg((mean("zurich") - mean("milano_linate")).alias("gradient")).filter("gradient IS NOT NULL")


@query("j09_latest_health", sql(f"""SELECT s.source, s.checked_at, s.ok, {r('s.latency_ms')} AS latency_ms, s.error_msg FROM fx_source_health s
JOIN (SELECT source, max(checked_at) AS m FROM fx_source_health GROUP BY 1) m ON s.source = m.source AND s.checked_at = m.m""", "fx_source_health"))
def j09(spark, sf):
    return health.latest_health(table(spark, sf, "fx_source_health"))


@query("j10_active_alerts", sql("""SELECT a.id, a.point_id, u.timezone, u.quiet_hours_start FROM fx_alerts a JOIN fx_users u USING (telegram_user_id) WHERE a.enabled""", "fx_alerts", "fx_users"))
def j10(spark, sf):
    return alerts.active(table(spark, sf, "fx_alerts"), table(spark, sf, "fx_users"), "timezone", "quiet_hours_start").select("id", "point_id", "timezone", "quiet_hours_start")


@query("j11_active_subscriptions", sql("SELECT s.id, s.local_time, u.timezone FROM fx_subscriptions s JOIN fx_users u USING (telegram_user_id) WHERE s.enabled", "fx_subscriptions", "fx_users"))
def j11(spark, sf):
    return alerts.active(table(spark, sf, "fx_subscriptions"), table(spark, sf, "fx_users"), "timezone").select("id", "local_time", "timezone")


RING_DEF = "(VALUES ('center', 0, 0), ('N', 0, 1), ('NE', 0.707, 0.707), ('E', 1, 0), ('SE', 0.707, -0.707), ('S', 0, -1), ('SW', -0.707, -0.707), ('W', -1, 0), ('NW', -0.707, 0.707)) d(direction, dx, dy)"
RADIUS, MAX_KM = 6.0, 8.0
RING = f"""ring AS (SELECT c.point_id AS centre_id, direction, c.lat + dy * {RADIUS}::DOUBLE / 111 AS lat, c.lon + dx * {RADIUS}::DOUBLE / (111 * cos(radians(c.lat))) AS lon
  FROM fx_points c CROSS JOIN {RING_DEF} WHERE c.is_operational),
placed AS (SELECT * FROM (SELECT s.centre_id, s.direction, o.point_id, {DIST} AS km, row_number() OVER (PARTITION BY s.centre_id, s.direction ORDER BY {DIST}, o.point_id) AS rn
  FROM ring s CROSS JOIN fx_points o) WHERE rn = 1 AND km <= {MAX_KM})"""
REF = """ref AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, t ORDER BY (model_name <> 'icon_eu')::INT, model_name) AS rk FROM found) WHERE rk = 1)"""
RING_FC = f"""{RING}, {SPINE}, {lookup_sql(60)}, {REF},
ring_fc AS (SELECT centre_id AS point_id, t, direction, wind_speed_kn AS wind_speed, wind_dir_deg AS wind_dir, pressure_msl AS pressure, temperature_2m AS temperature FROM ref JOIN placed USING (point_id))"""


def ring_df(spark, sf):
    p = table(spark, sf, "fx_points").filter("is_operational")
    return spatial.ring_forecasts(p, full_spine(spark, sf), table(spark, sf, "fx_forecast_runs"), cfg.POINTS, RADIUS, MAX_KM, TB)


@query("j12_ring_lookup", sql(f"WITH {RING_FC} SELECT point_id, t, direction, {doubles('wind_speed wind_dir pressure temperature')} FROM ring_fc", "fx_points", "fx_forecast_runs"))
def j12(spark, sf):
    return ring_df(spark, sf)


LAG_SRC = """lagged AS (SELECT DISTINCT point_id, t - lag * INTERVAL '1' MINUTE AS t FROM spine CROSS JOIN (VALUES (15), (60), (240)) l(lag))"""


def j13_sql(causal: bool) -> str:
    return sql(f"""WITH {OP_SPINE}, {LAG_SRC}, {lookup_sql(120, 'lagged', causal)}, {REF}
SELECT s.point_id, s.t, {', '.join(f"{r(f'l{m}.{c}')} AS lag{m}_{n}" for m in (15, 60, 240) for c, n in (('wind_speed_kn', 'speed'), ('wind_dir_deg', 'dir'), ('pressure_msl', 'press'), ('temperature_2m', 'temp')))}
FROM spine s {' '.join(f"LEFT JOIN ref l{m} ON l{m}.point_id = s.point_id AND l{m}.t = s.t - INTERVAL '{m}' MINUTE" for m in (15, 60, 240))}""", "fx_points", "fx_forecast_runs")


def lags_df(spark, sf, causal):
    s = full_spine(spark, sf, True).select("point_id", "t")
    got = features.lagged_forecasts(s, table(spark, sf, "fx_forecast_runs"), causal=causal, tie_break=TB)
    cols = [f"lag{m}_{n}" for m in cfg.LAG_MINUTES for n in ("speed", "dir", "press", "temp")]
    return s.join(got, ["point_id", "t"], "left").select("point_id", "t", *cols)


@query("j13_lag_lookups", j13_sql(True))
def j13(spark, sf):
    return lags_df(spark, sf, True)


@query("j13_lag_lookups_as_coded", j13_sql(False))
def j13_coded(spark, sf):
    """Window on both sides of the wanted time."""
    return lags_df(spark, sf, False)


BT = dict(train_days=7, test_days=5, step_days=3)


@query("j14_window_membership", sql("""WITH w AS (SELECT i AS window_id, TIMESTAMP '2024-01-08' + i * INTERVAL '3' DAY AS a FROM range(0, 7) t(i))
SELECT id, valid_time, window_id FROM fx_forecast_runs f JOIN w ON valid_time >= a AND valid_time < a + INTERVAL '5' DAY WHERE a + INTERVAL '5' DAY <= TIMESTAMP '2024-01-31'""", "fx_forecast_runs"))
def j14(spark, sf):
    f = table(spark, sf, "fx_forecast_runs").select("id", "valid_time")
    return crossval.with_windows(f, datetime(2024, 1, 1), datetime(2024, 1, 31), **BT)


@query("j16_point_enrichment", sql(f"SELECT id, point_id, {doubles('wind_speed_kn lat lon')} FROM fx_predictions JOIN fx_points USING (point_id)", "fx_predictions"))
def j16(spark, sf):
    return serve.enrich_with_points(table(spark, sf, "fx_predictions"), table(spark, sf, "fx_points")).select("id", "point_id", "wind_speed_kn", "lat", "lon")


@query("j17_missing_hours", sql(f"""WITH {SPINE} SELECT s.point_id, s.t AS hour FROM spine s WHERE NOT EXISTS (
SELECT 1 FROM fx_forecast_runs f WHERE f.point_id = s.point_id AND date_trunc('hour', f.valid_time) = s.t)""", "fx_forecast_runs"))
def j17(spark, sf):
    return health.missing_hours(table(spark, sf, "fx_points"), table(spark, sf, "fx_forecast_runs"), ts(START), ts(END))


# --- W ---


@query("w01_newest_run_per_model", sql(f"WITH {SPINE}, {lookup_sql(30)} SELECT point_id, model_name, count(*) AS n, sum(id)::BIGINT AS ids FROM found GROUP BY ALL", "fx_forecast_runs"))
def w01(spark, sf):
    found = asof.forecasts_at(full_spine(spark, sf), table(spark, sf, "fx_forecast_runs"), ["id"], 30, tie_break=TB)
    return found.groupBy("point_id", "model_name").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("w02_latest_at_target", sql(f"""SELECT point_id, id, valid_time, generated_at, {doubles('wind_speed_kn')} FROM (
SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY generated_at DESC, id DESC) AS rn FROM fx_predictions
WHERE abs(date_diff('microsecond', valid_time, TIMESTAMP '2024-01-20 12:00:00')) < 3600000000) WHERE rn = 1""", "fx_predictions"))
def w02(spark, sf):
    return serve.latest_at(table(spark, sf, "fx_predictions"), as_of(), tie_break=TB).select("point_id", "id", "valid_time", "generated_at", "wind_speed_kn")


@query("w03_run_lengths", sql("""WITH p AS (SELECT *, wind_speed_kn >= 8 AS ok FROM fx_predictions),
g AS (SELECT *, row_number() OVER (PARTITION BY point_id, valid_time::DATE ORDER BY valid_time, generated_at DESC, id DESC)
  - row_number() OVER (PARTITION BY point_id, valid_time::DATE, ok ORDER BY valid_time, generated_at DESC, id DESC) AS island FROM p),
runs AS (SELECT point_id, valid_time::DATE AS day, island, count(*) AS n FROM g WHERE ok GROUP BY ALL)
SELECT point_id, CAST(day AS VARCHAR) AS day, coalesce(max(n), 0) AS max_run FROM (SELECT DISTINCT point_id, valid_time::DATE AS day FROM p) LEFT JOIN runs USING (point_id, day) GROUP BY ALL""", "fx_predictions"))
def w03(spark, sf):
    p = table(spark, sf, "fx_predictions").withColumn("day", F.to_date("valid_time"))
    order = [F.col("valid_time"), F.col("generated_at").desc(), F.col("id").desc()]
    return alerts.run_lengths(p, ["point_id", "day"], order, F.col("wind_speed_kn") >= 8, chunk="valid_time")


W4 = sql(f"""WITH {OP_SPINE}, {LAG_SRC}, {lookup_sql(120, 'lagged', True)}, {REF}, {lookup_sql(30, name='own')}
SELECT o.point_id, o.t, {', '.join(f"{r(f'(o.wind_speed_kn - l{m}.wind_speed_kn) / ({m} / 60.0::DOUBLE)')} AS lag{m}_speed_dt" for m in (15, 60, 240))}
FROM own o {' '.join(f"LEFT JOIN ref l{m} ON l{m}.point_id = o.point_id AND l{m}.t = o.t - INTERVAL '{m}' MINUTE" for m in (15, 60, 240))} WHERE o.model_name = 'icon_eu'""", "fx_points", "fx_forecast_runs")


@query("w04_lag_derivatives", W4)
def w04(spark, sf):
    f = table(spark, sf, "fx_forecast_runs")
    s = full_spine(spark, sf, True).select("point_id", "t")
    own = features.forecast_features(s, f, tie_break=TB).select("point_id", "t", "fc_icon_eu_speed")
    lags = features.lagged_forecasts(s, f, tie_break=TB)
    d = features.lag_derivatives(F.col("fc_icon_eu_speed"))
    return own.join(lags, ["point_id", "t"], "left").select("point_id", "t", *[c.alias(n) for n, c in d.items()])


OBSERVED = f"""obs_samples AS (SELECT point_id, t AS valid_time, idx AS p_order, wind_speed_kn AS obs_speed FROM near JOIN spine USING (point_id, t))"""


def observed_df(spark, sf):
    s = full_spine(spark, sf, True)
    n = nearest.nearest_observation(s, table(spark, sf, "fx_observations"), cfg.OPERATIONAL, max_age_min=60, tie_break=TB)
    return s.join(n.select("point_id", "t", F.col("wind_speed_kn").alias("obs_speed")), ["point_id", "t"]).withColumnRenamed("t", "valid_time")


def w05_sql(per_point: bool) -> str:
    prev = (
        "lag(obs_speed) OVER (PARTITION BY point_id ORDER BY valid_time)" if per_point else
        "CASE WHEN lag(point_id) OVER (ORDER BY valid_time, p_order) = point_id THEN lag(obs_speed) OVER (ORDER BY valid_time, p_order) END"
    )
    return sql(f"WITH {OP_SPINE}, {nearest_sql(0, 60)}, {OBSERVED} SELECT point_id, valid_time, {r('pers')} AS pers_speed FROM (SELECT *, {prev} AS pers FROM obs_samples)", "fx_points", "fx_observations")


@query("w05_previous_sample", w05_sql(False))
def w05(spark, sf):
    return verify.previous_observation(observed_df(spark, sf), ["valid_time"]).select("point_id", "valid_time", "pers_speed")


@query("w05_previous_sample_per_point", w05_sql(True))
def w05_point(spark, sf):
    return verify.previous_observation(observed_df(spark, sf), ["valid_time"], per_point=True).select("point_id", "valid_time", "pers_speed")


@query("w06_commands_last_hour", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' HOUR PRECEDING AND CURRENT ROW) AS n_last_hour FROM events""")
def w06(spark, sf):
    from sparkmos.operators import limits

    return limits.commands_last_hour(raw(spark, sf, "events"), "user_id", "ts").select("event_id", "n_last_hour")


CHANGE_T = """targets AS (SELECT point_id, TIMESTAMP '2024-01-20 12:00:00' - b * INTERVAL '1' HOUR AS target, b FROM fx_points CROSS JOIN (VALUES (0), (1)) t(b))"""


@query("w07_hour_change", sql(f"""WITH {CHANGE_T}, {PRED_AT}, s AS (SELECT p.point_id, max(CASE WHEN b = 0 THEN wind_speed_kn END) AS a, max(CASE WHEN b = 1 THEN wind_speed_kn END) AS z FROM fx_points p LEFT JOIN found USING (point_id) GROUP BY 1)
SELECT point_id, {r('a')} AS speed_now, {r('z')} AS speed_before, CASE WHEN a IS NULL THEN 'none' WHEN z IS NULL THEN 'no_prior' WHEN abs(a - z) < 0.5 THEN 'steady' WHEN a > z THEN 'up' ELSE 'down' END AS change FROM s""", "fx_predictions"))
def w07(spark, sf):
    return serve.hour_change(table(spark, sf, "fx_points"), table(spark, sf, "fx_predictions"), as_of(), TB)


@query("w08_trend", sql(f"SELECT point_id, id, valid_time, {doubles('wind_speed_kn confidence_pct')} FROM fx_predictions WHERE valid_time >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '25' HOUR AND valid_time <= TIMESTAMP '2024-01-20 12:00:00' + INTERVAL '24' HOUR", "fx_predictions"))
def w08(spark, sf):
    return serve.trend(table(spark, sf, "fx_predictions"), as_of(), 24).select("point_id", "id", "valid_time", "wind_speed_kn", "confidence_pct")


@query("w09_last_pairs", sql(f"WITH {PAIRS} SELECT id, point_id, {doubles('error')} FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY valid_time DESC, id DESC) AS rn FROM pairs) WHERE rn <= 100", "fx_predictions", "fx_observations"))
def w09(spark, sf):
    return verify.last_pairs(pairs_df(spark, sf), 100, TB).select("id", "point_id", "error")


OUTLOOK = PRED_AT.replace("q.point_id, q.target ORDER", "q.point_id, q.h ORDER")


@query("w10_hourly_outlook", sql(f"""WITH targets AS (SELECT point_id, h, TIMESTAMP '2024-01-20 12:00:00' + h * INTERVAL '1' HOUR AS target FROM fx_points CROSS JOIN range(0, 25) t(h)), {OUTLOOK}
SELECT point_id, h, id, valid_time FROM found""", "fx_predictions"))
def w10(spark, sf):
    return serve.hourly_outlook(table(spark, sf, "fx_points"), table(spark, sf, "fx_predictions"), as_of(), 24, TB).select("point_id", "h", "id", "valid_time")


# --- L ---


@query("l01_latest_predictions", sql("SELECT id, point_id, generated_at FROM fx_predictions ORDER BY generated_at DESC, valid_time, id DESC LIMIT 100", "fx_predictions"))
def l01(spark, sf):
    return serve.latest_predictions(table(spark, sf, "fx_predictions"), 100, tie_break=TB).select("id", "point_id", "generated_at")


@query("l02_newest_per_point", sql("SELECT id, point_id, rn FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY generated_at DESC, valid_time, id DESC) AS rn FROM fx_predictions) WHERE rn <= 200", "fx_predictions"))
def l02(spark, sf):
    return serve.latest_per_point(table(spark, sf, "fx_predictions"), 200, TB).select("id", "point_id", "rn")


@query("l03_production_model", sql(f"SELECT model_version, trained_at, {doubles('backtest_mae_kn')} FROM fx_model_registry ORDER BY promoted_to_production DESC, trained_at DESC, model_version LIMIT 1", "fx_model_registry"))
def l03(spark, sf):
    return health.production_model(table(spark, sf, "fx_model_registry")).select("model_version", "trained_at", "backtest_mae_kn")


@query("l03_production_fallback", sql("SELECT model_version, trained_at FROM fx_model_registry ORDER BY trained_at DESC, model_version LIMIT 1", "fx_model_registry"))
def l03_fallback(spark, sf):
    """No promoted model: the newest trained one."""
    reg = table(spark, sf, "fx_model_registry").withColumn("promoted_to_production", F.lit(False))
    return health.production_model(reg).select("model_version", "trained_at")


@query("l04_recent_failures", sql("SELECT source, checked_at, error_msg FROM fx_source_health WHERE NOT ok ORDER BY checked_at DESC, source LIMIT 3", "fx_source_health"))
def l04(spark, sf):
    return health.recent_failures(table(spark, sf, "fx_source_health")).select("source", "checked_at", "error_msg")


@query("l04_recent_users", sql("SELECT telegram_user_id, last_seen_at FROM fx_users ORDER BY last_seen_at DESC, telegram_user_id LIMIT 5", "fx_users"))
def l04_users(spark, sf):
    return health.newest(table(spark, sf, "fx_users"), "last_seen_at", 5, "telegram_user_id").select("telegram_user_id", "last_seen_at")


@query("l05_best_point", sql(f"SELECT point_id, {doubles('wind_speed_kn confidence_pct')} FROM fx_predictions WHERE confidence_pct >= 50 ORDER BY wind_speed_kn DESC, point_id LIMIT 1", "fx_predictions"))
def l05(spark, sf):
    return serve.best_now(table(spark, sf, "fx_predictions")).select("point_id", "wind_speed_kn", "confidence_pct")


