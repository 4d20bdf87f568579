"""Aggregates. Scores of backtests are in ``scoring``."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fx import YEARS_BACK, as_of, doubles, query, r, raw, sql, table
from checks.ingest import ensemble_payloads
from checks.lookups import OP_SPINE, PAIRS, REF, RING_FC, TB, full_spine, lookup_sql, pairs_df, ring_df
from sparkmos.operators import climatology as clim
from sparkmos.operators import health, serve, spatial, verify
from sparkmos.plans import features
from sparkmos.sources import payload

CUT = f"INTERVAL '{365 * YEARS_BACK}' DAY"
# Every sample with every historical row of its window.
IN_WINDOW = f"""s.point_id = c.point_id AND dayofyear(c.timestamp) BETWEEN greatest(1, dayofyear(s.t) - 15) AND least(366, dayofyear(s.t) + 15) AND c.timestamp >= s.t - {CUT}"""


def clim_df(spark, sf):
    return table(spark, sf, "fx_climatology")


def norm(spark, sf):
    return clim.normals(full_spine(spark, sf, True), clim_df(spark, sf), years_back=YEARS_BACK)


def a_sql(select: str, where: str = "TRUE") -> str:
    return sql(f"WITH {OP_SPINE} SELECT s.point_id, s.t, {select} FROM spine s LEFT JOIN fx_climatology c ON {IN_WINDOW} AND {where} GROUP BY ALL", "fx_points", "fx_climatology")


@query("a01_climatology_normal", a_sql(f"{r('avg(wind_speed_10m)')} AS climatology_wind_speed_normal, {r('avg(temperature_2m)')} AS climatology_temp_normal, {r('avg(pressure_msl)')} AS climatology_pressure_normal"))
def a01(spark, sf):
    return norm(spark, sf).select("point_id", "t", *[f"climatology_{x}_normal" for x in ("wind_speed", "temp", "pressure")])


@query("a02_direction_normal", a_sql(f"{r('(degrees(atan2(sum(sin(radians(wind_direction_10m))), sum(cos(radians(wind_direction_10m))))) + 360) % 360', 4)} AS climatology_wind_dir_normal"))
def a02(spark, sf):
    return norm(spark, sf).select("point_id", "t", F.round("climatology_wind_dir_normal", 4).alias("climatology_wind_dir_normal"))


@query("a03_midday_strength", a_sql(f"{r('avg(wind_speed_10m)')} AS climatology_breva_strength", "hour(c.timestamp) BETWEEN 11 AND 16"))
def a03(spark, sf):
    return norm(spark, sf).select("point_id", "t", "climatology_breva_strength")


TIMES = "times AS (SELECT t FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1' HOUR) g(t))"


def daily_mean(point: str, name: str) -> str:
    return f"""{name} AS (SELECT s.t, c.timestamp::DATE AS d, avg(pressure_msl) AS p FROM times s JOIN fx_climatology c
  ON dayofyear(c.timestamp) BETWEEN greatest(1, dayofyear(s.t) - 15) AND least(366, dayofyear(s.t) + 15) AND c.timestamp >= s.t - {CUT} AND c.point_id = '{point}' GROUP BY ALL)"""


A4 = sql(f"""WITH {TIMES}, {daily_mean('zurich', 'z')}, {daily_mean('milano_linate', 'm')},
days AS (SELECT s.t, count(DISTINCT c.timestamp::DATE) AS n FROM times s LEFT JOIN fx_climatology c ON c.point_id = 'zurich' AND c.timestamp >= s.t - {CUT} GROUP BY 1),
freq AS (SELECT t, avg(CASE WHEN z.p - m.p >= 8 THEN 1.0 ELSE 0 END) * 100 AS f FROM z JOIN m USING (t, d) GROUP BY 1)
SELECT t, CASE WHEN n >= 30 THEN {r('f', 2)} END AS climatology_foehn_frequency, n AS n_north_days FROM days LEFT JOIN freq USING (t)""", "fx_climatology")


@query("a04_foehn_frequency", A4)
def a04(spark, sf):
    return clim.foehn_frequency(full_spine(spark, sf), clim_df(spark, sf), years_back=YEARS_BACK)


A5 = sql(f"""WITH {OP_SPINE}, {lookup_sql(30)}, s AS (SELECT point_id, t, wind_speed_kn AS fc FROM found WHERE model_name = 'icon_eu')
SELECT s.point_id, s.t, {r('count(*) FILTER (WHERE wind_speed_10m < fc) * 100.0::DOUBLE / count(*)', 1)} AS seasonal_wind_percentile
FROM s JOIN fx_climatology c ON {IN_WINDOW} GROUP BY ALL""", "fx_points", "fx_forecast_runs", "fx_climatology")


def own_speed(spark, sf):
    f = features.forecast_features(full_spine(spark, sf, True), table(spark, sf, "fx_forecast_runs"), tie_break=TB)
    return f.select("point_id", "t", F.col("fc_icon_eu_speed").alias("fc_speed"))


@query("a05_seasonal_percentile", A5)
def a05(spark, sf):
    return clim.seasonal_percentile(own_speed(spark, sf), clim_df(spark, sf), years_back=YEARS_BACK)


@query("a06_distinct_days", sql("SELECT point_id, count(DISTINCT timestamp::DATE) AS n_days FROM fx_climatology GROUP BY 1", "fx_climatology"))
def a06(spark, sf):
    """Days first: the distinct count is then a plain count."""
    return clim_df(spark, sf).select("point_id", F.to_date("timestamp").alias("day")).distinct().groupBy("point_id").agg(F.count("*").alias("n_days"))


def extent_sql(name: str, time: str, src: str) -> str:
    gap = f"date_diff('microsecond', max({time}), TIMESTAMP '2024-01-20 12:00:00') / 86400e6"
    return f"SELECT '{name}' AS dataset, min({time}) AS earliest, max({time}) AS latest, count(*) AS n, {r(gap, 2)} AS gap_days, {gap} > 1 AS needs_recovery FROM {src}"


@query("a07_extent", sql(extent_sql("forecast_runs", "run_time", "fx_forecast_runs") + " UNION ALL " + extent_sql("observations", "timestamp", "fx_observations"), "fx_forecast_runs", "fx_observations"))
def a07(spark, sf):
    return health.extent(table(spark, sf, "fx_forecast_runs"), "run_time", as_of(), "forecast_runs").unionByName(
        health.extent(table(spark, sf, "fx_observations"), "timestamp", as_of(), "observations")
    )


GAP_H = "date_diff('microsecond', max(timestamp), TIMESTAMP '2024-01-20 12:00:00') / 3600e6"


@query("a08_extent_by_source", sql(f"SELECT source, max(timestamp) AS latest, count(*) AS n, {r(GAP_H, 1)} AS gap_hours FROM fx_observations GROUP BY 1", "fx_observations"))
def a08(spark, sf):
    return health.extent_by_source(table(spark, sf, "fx_observations"), as_of())


@query("a09_member_statistics", sql(f"""WITH hours AS (SELECT e.*, i FROM fx_events e CROSS JOIN range(0, 6) t(i)),
speed AS (SELECT event_id, i, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std FROM (
  SELECT event_id, i, CASE WHEN (event_id + i + j) % 6 <> 0 THEN value * (0.8 + 0.1 * j) + i * j END AS v FROM hours CROSS JOIN (VALUES (1), (2), (3), (4)) m(j)) GROUP BY ALL)
SELECT n AS n_members, count(*) AS n_rows, {r('avg(mean)', 4)} AS mean_of_means, {r('avg(std)', 4)} AS mean_std FROM speed GROUP BY 1""", "fx_events"))
def a09(spark, sf):
    rows = payload.ensemble_rows(ensemble_payloads(spark, sf), as_of())
    return rows.groupBy(F.col("spread.n_members").alias("n_members")).agg(
        F.count("*").alias("n_rows"), F.round(F.avg("spread.speed_mean"), 4).alias("mean_of_means"), F.round(F.avg("spread.speed_std"), 4).alias("mean_std")
    )


AGE = "date_diff('microsecond', valid_time, TIMESTAMP '2024-01-20 12:00:00') / 86400e6"
DECIDE = "hour(valid_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome') BETWEEN 11 AND 16"
A16 = sql(f"""WITH {PAIRS} SELECT point_id, {r(f'avg(abs_error) FILTER (WHERE {AGE} <= 7)')} AS mae_7d, count(abs_error) FILTER (WHERE {AGE} <= 7) AS n_7d,
  {r('avg(abs_error)')} AS mae_30d, count(*) AS n_30d, {r('avg(dir_error)')} AS dir_error, count(dir_error) AS n_dir,
  {r('avg(abs_error) FILTER (WHERE is_reanalysis)')} AS mae_reanalysis, {r('avg(abs_error) FILTER (WHERE NOT is_reanalysis)')} AS mae_station,
  {r(f'avg(((wind_speed_kn >= 8) = (obs_speed >= 8))::INT) FILTER (WHERE {DECIDE}) * 100')} AS hit_rate_pct, count(*) FILTER (WHERE {DECIDE}) AS n_decisions
FROM pairs WHERE {AGE} <= 30 GROUP BY 1""", "fx_predictions", "fx_observations")


@query("a16_accuracy_report", A16)
def a16(spark, sf):
    return verify.accuracy_report(pairs_df(spark, sf), as_of())


LOCAL_HOURS = """targets AS (SELECT point_id, idx, h AS hour, ((DATE '2024-01-20' + h * INTERVAL '1' HOUR) AT TIME ZONE 'Europe/Rome' AT TIME ZONE 'UTC') AS target
  FROM fx_points CROSS JOIN range(11, 17) t(h) WHERE is_operational)"""
A20 = sql(f"""WITH {LOCAL_HOURS}, found AS (SELECT * FROM (SELECT q.*, p.wind_speed_kn,
  row_number() OVER (PARTITION BY q.point_id, q.hour ORDER BY abs(date_diff('microsecond', p.valid_time, q.target)), p.generated_at DESC, p.valid_time, p.id DESC) AS rn
  FROM targets q JOIN fx_predictions p ON p.point_id = q.point_id AND abs(date_diff('microsecond', p.valid_time, q.target)) <= 3600000000) WHERE rn = 1 AND wind_speed_kn <> 0),
g AS (SELECT point_id, idx, max(wind_speed_kn) AS max_speed, avg(wind_speed_kn) AS avg_speed, count(*) FILTER (WHERE wind_speed_kn >= 8) AS sail_hours, arg_min(hour, (-wind_speed_kn, hour)) AS best_hour FROM found GROUP BY ALL)
SELECT point_id, {doubles('max_speed avg_speed')}, sail_hours, best_hour,
  sail_hours >= 2 AND row_number() OVER (ORDER BY (sail_hours >= 2) DESC, max_speed DESC, idx) = 1 AS best FROM g""", "fx_points", "fx_predictions")


@query("a20_sailing_report", A20)
def a20(spark, sf):
    p = table(spark, sf, "fx_points").filter("is_operational")
    return serve.sailing_report(p, table(spark, sf, "fx_predictions"), as_of(), TB)


@query("a22_usage", sql("""SELECT count(*) AS total_users, count(*) FILTER (WHERE is_allowed) AS allowed_users,
  count(*) FILTER (WHERE last_seen_at > TIMESTAMP '2024-01-19 12:00:00') AS active_24h, count(*) FILTER (WHERE last_seen_at > TIMESTAMP '2024-01-13 12:00:00') AS active_7d,
  (SELECT count(*) FROM fx_alerts WHERE enabled) AS active_alerts FROM fx_users""", "fx_users", "fx_alerts"))
def a22(spark, sf):
    return health.usage(table(spark, sf, "fx_users"), table(spark, sf, "fx_alerts"), as_of())


COUNTED = ["fx_forecast_runs", "fx_observations", "fx_predictions", "fx_model_registry"]


@query("a23_row_counts", sql(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in COUNTED), *COUNTED))
def a23(spark, sf):
    return health.row_counts({t: table(spark, sf, t) for t in COUNTED})


HOURS6 = f"""lagged AS (SELECT DISTINCT point_id, t - h * INTERVAL '1' HOUR AS t FROM spine CROSS JOIN range(0, 6) l(h)), {lookup_sql(120, 'lagged', True)}, {REF},
hist AS (SELECT s.point_id, s.t, h, temperature_2m AS temp, shortwave_radiation AS rad FROM spine s CROSS JOIN range(0, 6) l(h) JOIN ref ON ref.point_id = s.point_id AND ref.t = s.t - h * INTERVAL '1' HOUR),
ti AS (SELECT point_id, t, avg(temp) AS m, (arg_min(temp, h) - arg_max(temp, h)) / greatest(count(temp) - 1, 1) AS tr, coalesce(sum(rad), 0) AS so, sum(rad) FILTER (WHERE h < 3) AS s3 FROM hist GROUP BY ALL)"""
TI_COLS = f"""{r('m', 2)} AS thermal_inertia_avg_temp, {r('tr', 4)} AS thermal_inertia_temp_trend, {r('so', 1)} AS thermal_inertia_solar_accum,
  {r('0.5 * least(1, so / 3000) + 0.2 * greatest(0, least(1, (tr + 2) / 4)) + 0.3 * greatest(0, least(1, (m - 5) / 30))', 4)} AS thermal_inertia_index"""


def lags(spark, sf):
    return features.lagged_forecasts(full_spine(spark, sf, True).select("point_id", "t"), table(spark, sf, "fx_forecast_runs"), tie_break=TB)


@query("a24_thermal_inertia", sql(f"WITH {OP_SPINE}, {HOURS6} SELECT s.point_id, s.t, {TI_COLS} FROM spine s JOIN ti USING (point_id, t)", "fx_points", "fx_forecast_runs"))
def a24(spark, sf):
    from sparkmos.functions import features as ff

    t = ff.thermal_inertia(F.col("ti_mean"), F.col("ti_newest"), F.col("ti_oldest"), F.col("ti_n"), F.col("ti_solar"))
    s = full_spine(spark, sf, True).select("point_id", "t").join(lags(spark, sf).filter("ti_mean IS NOT NULL"), ["point_id", "t"])
    return s.select("point_id", "t", *[c.alias(n) for n, c in t.items()])


@query("a25_solar_3h", sql(f"WITH {OP_SPINE}, {HOURS6} SELECT s.point_id, s.t, {r('s3', 1)} AS solar_3h FROM spine s JOIN ti USING (point_id, t) WHERE s3 IS NOT NULL", "fx_points", "fx_forecast_runs"))
def a25(spark, sf):
    s = full_spine(spark, sf, True).select("point_id", "t").join(lags(spark, sf), ["point_id", "t"])
    return s.select("point_id", "t", F.round("solar_3h", 1).alias("solar_3h")).filter("solar_3h IS NOT NULL")


RIM = "FILTER (WHERE direction <> 'center')"
A26 = sql(f"""WITH {RING_FC}, g AS (SELECT point_id, t, count(pressure) {RIM} AS np, stddev_pop(pressure) {RIM} AS sp, avg(pressure) {RIM} - max(pressure) FILTER (WHERE direction = 'center') AS lap,
  count(wind_dir) {RIM} AS nd, 1 - sqrt(pow(sum(sin(radians(wind_dir))) {RIM}, 2) + pow(sum(cos(radians(wind_dir))) {RIM}, 2)) / nullif(count(wind_dir) {RIM}, 0) AS cv,
  count(wind_speed) {RIM} AS ns, max(wind_speed) {RIM} - min(wind_speed) {RIM} AS rs, avg(wind_speed) {RIM} AS ms FROM ring_fc GROUP BY ALL)
SELECT point_id, t, CASE WHEN np >= 4 THEN {r('sp', 3)} END AS grid_pressure_std, CASE WHEN np >= 6 THEN {r('lap', 3)} END AS grid_pressure_laplacian,
  CASE WHEN nd >= 4 THEN {r('cv', 4)} END AS grid_wind_dir_circvar, CASE WHEN ns >= 4 THEN {r('rs', 2)} END AS grid_wind_speed_range, CASE WHEN ns >= 4 THEN {r('ms', 2)} END AS grid_wind_speed_mean FROM g""", "fx_points", "fx_forecast_runs")


@query("a26_ring_statistics", A26)
def a26(spark, sf):
    g = spatial.ring_features(ring_df(spark, sf))
    return g.select("point_id", "t", "grid_pressure_std", "grid_pressure_laplacian", "grid_wind_dir_circvar", "grid_wind_speed_range", "grid_wind_speed_mean")


@query("a28_retrain_decision", sql("""WITH m AS (SELECT max(trained_at) AS last_trained FROM fx_model_registry)
SELECT last_trained, (SELECT count(*) FROM fx_forecast_runs WHERE run_time > last_trained) AS n_new, (SELECT count(*) FROM fx_forecast_runs WHERE run_time > last_trained) > 5000 AS retrain FROM m""", "fx_model_registry", "fx_forecast_runs"))
def a28(spark, sf):
    return health.retrain_decision(table(spark, sf, "fx_model_registry"), table(spark, sf, "fx_forecast_runs"))


@query("a29_error_histogram", sql(f"""WITH {PAIRS}, b AS (SELECT min(error) AS lo, max(error) AS hi FROM pairs)
SELECT CAST(least(floor((error - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin, count(*) AS n, {r('lo')} AS lo, {r('hi')} AS hi FROM pairs CROSS JOIN b GROUP BY ALL""", "fx_predictions", "fx_observations"))
def a29(spark, sf):
    return verify.error_histogram(pairs_df(spark, sf))


@query("a29_mae_by_source", sql(f"WITH {PAIRS} SELECT is_reanalysis, count(*) AS n, {r('avg(abs_error)')} AS mae, {r('avg(error)')} AS mean_error FROM pairs GROUP BY 1", "fx_predictions", "fx_observations"))
def a29_source(spark, sf):
    return pairs_df(spark, sf).groupBy("is_reanalysis").agg(F.count("*").alias("n"), F.avg("abs_error").alias("mae"), F.avg("error").alias("mean_error"))


@query("a30_points_by_sector", """SELECT CAST(n_regionkey AS BIGINT) AS sector, string_agg(n_name, ',' ORDER BY n_name) AS points, count(*) AS n FROM nation GROUP BY 1""")
def a30(spark, sf):
    n = raw(spark, sf, "nation").select(F.col("n_regionkey").alias("sector"), F.col("n_name").alias("point_id"))
    return serve.points_by_sector(n).select("sector", F.concat_ws(",", "points").alias("points"), "n")


