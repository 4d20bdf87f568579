"""Alerts, digests, recovery, gridded field, status."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fx import as_of, doubles, query, r, sql, table
from checks.lookups import TB
from checks.scalars import SHORE_EDGES
from sparkmos.operators import alerts, health, serve, spatial
from sparkmos.sources import backfill

FX = ("fx_alerts", "fx_users", "fx_predictions")
NOW = "TIMESTAMP '2024-01-20 12:00:00'"
READY = f"""ready AS (SELECT * FROM (SELECT a.*, hour(l) * 60 + minute(l) AS m, CAST(left(quiet_hours_start, 2) AS INT) * 60 + CAST(right(quiet_hours_start, 2) AS INT) AS qa, CAST(left(quiet_hours_end, 2) AS INT) * 60 + CAST(right(quiet_hours_end, 2) AS INT) AS qb
  FROM fx_alerts a JOIN (SELECT *, {NOW} AT TIME ZONE 'UTC' AT TIME ZONE timezone AS l FROM fx_users) u USING (telegram_user_id) WHERE a.enabled)
  WHERE NOT (CASE WHEN qa <= qb THEN m BETWEEN qa AND qb ELSE m >= qa OR m <= qb END) AND (last_triggered_at IS NULL OR date_diff('second', last_triggered_at, {NOW}) >= 21600))"""


def d17_sql(latest: bool) -> str:
    src = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, valid_time ORDER BY generated_at DESC, id DESC) AS g FROM fx_predictions) WHERE g = 1)" if latest else "fx_predictions"
    # Direct form: every start position, the next k rows must all reach the threshold.
    return sql(f"""WITH {READY}, f AS (SELECT a.id, a.threshold_kn, greatest(1, a.min_duration_minutes // 60) AS k, p.valid_time, p.wind_speed_kn,
  row_number() OVER (PARTITION BY a.id ORDER BY p.valid_time, p.generated_at DESC, p.id DESC) AS pos FROM ready a JOIN {src} p USING (point_id)
  WHERE p.valid_time >= {NOW} AND p.valid_time <= {NOW} + a.lead_window_hours * INTERVAL '1' HOUR),
met AS (SELECT DISTINCT s.id FROM f s JOIN f x ON x.id = s.id AND x.pos BETWEEN s.pos AND s.pos + s.k - 1 GROUP BY s.id, s.pos, s.k HAVING count(*) = s.k AND bool_and(x.wind_speed_kn >= x.threshold_kn)),
pk AS (SELECT id, max(wind_speed_kn) AS peak_kn, arg_min(valid_time, (-wind_speed_kn, valid_time)) AS peak_time FROM f GROUP BY 1)
SELECT r.id, r.point_id, r.threshold_kn, {r('peak_kn')} AS peak_kn, peak_time FROM ready r JOIN met USING (id) JOIN pk USING (id)""", *FX)


def due(spark, sf, latest: bool):
    t = lambda n: table(spark, sf, n)
    d = alerts.due_alerts(t("fx_alerts"), t("fx_users"), t("fx_predictions"), as_of(), latest_generation=latest, tie_break=TB)
    return d.select("id", "point_id", "threshold_kn", "peak_kn", "peak_time")


@query("d17_due_alerts", d17_sql(True))
def d17(spark, sf):
    return due(spark, sf, True)


@query("d17_due_alerts_as_coded", d17_sql(False))
def d17_coded(spark, sf):
    """Every stored generation of a forecast hour counts as a row of the run."""
    return due(spark, sf, False)


DUE_SUB = f"""due AS (SELECT * FROM (SELECT s.*, timezone, {NOW} AT TIME ZONE 'UTC' AT TIME ZONE timezone AS l, last_sent_at AT TIME ZONE 'UTC' AT TIME ZONE timezone AS ls FROM fx_subscriptions s JOIN fx_users USING (telegram_user_id) WHERE s.enabled)
  WHERE abs(hour(l) * 60 + minute(l) - CAST(left(local_time, 2) AS INT) * 60 - CAST(right(local_time, 2) AS INT)) <= 30 AND NOT coalesce(ls::DATE = l::DATE, FALSE))"""


@query("f21_subscription_due", sql(f"WITH {DUE_SUB} SELECT id, local_time, timezone FROM due", "fx_subscriptions", "fx_users"))
def f21(spark, sf):
    return alerts.due_subscriptions(table(spark, sf, "fx_subscriptions"), table(spark, sf, "fx_users"), as_of()).select("id", "local_time", "timezone")


D18 = sql(f"""WITH {DUE_SUB}, q AS (SELECT z.timezone, p.point_id, p.idx, h AS hour, ((({NOW} AT TIME ZONE 'UTC' AT TIME ZONE z.timezone)::DATE + h * INTERVAL '1' HOUR) AT TIME ZONE z.timezone AT TIME ZONE 'UTC') AS target
  FROM (SELECT DISTINCT timezone FROM due) z CROSS JOIN fx_points p CROSS JOIN range(11, 17) t(h) WHERE p.is_operational),
f AS (SELECT * FROM (SELECT q.*, p.wind_speed_kn, row_number() OVER (PARTITION BY q.timezone, q.point_id, q.hour ORDER BY abs(date_diff('microsecond', p.valid_time, q.target)), p.generated_at DESC, p.valid_time, p.id DESC) AS rn
  FROM q JOIN fx_predictions p ON p.point_id = q.point_id AND abs(date_diff('microsecond', p.valid_time, q.target)) <= 3600000000) WHERE rn = 1 AND wind_speed_kn > 0),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY timezone ORDER BY wind_speed_kn DESC, idx, hour) AS k FROM f) WHERE k = 1)
SELECT due.id, due.timezone, b.point_id AS best_point, b.hour AS best_hour, {r('b.wind_speed_kn')} AS best_speed, b.wind_speed_kn >= 8 AS go FROM due LEFT JOIN b USING (timezone)""", "fx_subscriptions", "fx_users", "fx_points", "fx_predictions")


@query("d18_digests", D18)
def d18(spark, sf):
    """Due subscriptions with the best midday hour in the owner's zone."""
    t = lambda n: table(spark, sf, n)
    d = alerts.due_subscriptions(t("fx_subscriptions"), t("fx_users"), as_of())
    out = alerts.digests(d, t("fx_points").filter("is_operational"), t("fx_predictions"), as_of(), TB)
    return out.select("id", "timezone", "best_point", "best_hour", "best_speed", "go")


A21 = sql(f"""WITH o AS (SELECT DISTINCT timezone, favorite_point_id AS point_id FROM fx_users),
q AS (SELECT o.*, h AS hour, ((({NOW} AT TIME ZONE 'UTC' AT TIME ZONE timezone)::DATE + h * INTERVAL '1' HOUR) AT TIME ZONE timezone AT TIME ZONE 'UTC') AS target FROM o CROSS JOIN range(8, 22) t(h))
SELECT timezone, point_id, hour, {r('wind_speed_kn')} AS wind_speed_kn FROM (SELECT q.*, p.wind_speed_kn, row_number() OVER (PARTITION BY q.timezone, q.point_id, q.hour ORDER BY abs(date_diff('microsecond', p.valid_time, q.target)), p.generated_at DESC, p.valid_time, p.id DESC) AS rn
  FROM q JOIN fx_predictions p ON p.point_id = q.point_id AND abs(date_diff('microsecond', p.valid_time, q.target)) <= 3600000000) WHERE rn = 1""", "fx_users", "fx_predictions")


@query("a21_favourite_hours", A21)
def a21(spark, sf):
    return alerts.favourite_hours(table(spark, sf, "fx_users"), table(spark, sf, "fx_predictions"), as_of(), TB).select("timezone", "point_id", "hour", "wind_speed_kn")


@query("d19_recovery_plan", sql(f"""WITH x AS (SELECT 'forecast_runs' AS dataset, max(run_time) AS latest FROM fx_forecast_runs UNION ALL SELECT 'climatology', max(timestamp) FROM fx_climatology),
p AS (SELECT *, latest - INTERVAL '1' HOUR AS a FROM x WHERE date_diff('microsecond', latest, TIMESTAMP '2024-03-20 12:00:00') / 86400e6 > 1)
SELECT dataset, a + i * INTERVAL '30' DAY AS chunk_start, least(a + (i + 1) * INTERVAL '30' DAY, TIMESTAMP '2024-03-20 12:00:00') AS chunk_end FROM p CROSS JOIN range(0, 40) t(i) WHERE a + i * INTERVAL '30' DAY < TIMESTAMP '2024-03-20 12:00:00'""", "fx_forecast_runs", "fx_climatology"))
def d19(spark, sf):
    from sparkmos.functions.common import ts

    now = ts("2024-03-20 12:00:00")
    e = health.extent(table(spark, sf, "fx_forecast_runs"), "run_time", now, "forecast_runs").unionByName(
        health.extent(table(spark, sf, "fx_climatology"), "timestamp", now, "climatology")
    )
    return backfill.chunks(health.recovery_ranges(e, now), "start", "end", 30).select("dataset", "chunk_start", "chunk_end")


@query("d20_incremental_ranges", sql("""SELECT p.point_id, coalesce(max(c.timestamp) + INTERVAL '1' HOUR, TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '1095' DAY) AS "start"
FROM (SELECT point_id FROM fx_points UNION ALL SELECT 'new_point') p LEFT JOIN fx_climatology c USING (point_id) GROUP BY 1""", "fx_climatology"))
def d20(spark, sf):
    """All points and one that has no history yet."""
    points = table(spark, sf, "fx_points")
    new = points.limit(1).withColumn("point_id", F.lit("new_point"))
    return backfill.incremental_ranges(points.unionByName(new), table(spark, sf, "fx_climatology"), as_of()).select("point_id", "start")


RES = 150
LON, LAT = (9.275, 9.330), (46.045, 46.165)
D22 = sql(f"""WITH {SHORE_EDGES},
val AS (SELECT date_trunc('day', valid_time) AS day, p.lat, p.lon, p.point_id, sum(wind_speed_kn) AS s, count(*) AS n FROM fx_predictions JOIN fx_points p USING (point_id) WHERE is_operational GROUP BY ALL),
cell AS (SELECT ix, iy, {LON[0]} + ({LON[1]} - {LON[0]})::DOUBLE / {RES - 1} * ix AS x, {LAT[0]} + ({LAT[1]} - {LAT[0]})::DOUBLE / {RES - 1} * iy AS y FROM range(0, {RES}) a(ix) CROSS JOIN range(0, {RES}) b(iy)),
wet AS (SELECT ix, iy, x, y FROM cell CROSS JOIN e WHERE (y1 > y) <> (y2 > y) AND x < (x1 - x2) * (y - y2) / (y1 - y2) + x2 GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT day, ix, iy, {r('sum(s / greatest(pow(x - lon, 2) + pow(y - lat, 2), 1e-12)) / sum(n / greatest(pow(x - lon, 2) + pow(y - lat, 2), 1e-12))')} AS wind_speed_kn FROM val CROSS JOIN wet GROUP BY ALL""", "fx_points", "fx_predictions")


@query("d22_gridded_field", D22)
def d22(spark, sf):
    p = serve.enrich_with_points(table(spark, sf, "fx_predictions"), table(spark, sf, "fx_points").filter("is_operational"))
    p = p.withColumn("day", F.date_trunc("day", "valid_time").cast("timestamp_ntz"))
    return spatial.gridded_field(p, ["day"], lon=LON, lat=LAT).select("day", "ix", "iy", "wind_speed_kn")


SLA = "CASE source WHEN 'open_meteo' THEN 60 WHEN 'open_meteo_ensemble' THEN 60 WHEN 'domaso_live' THEN 20 WHEN 'arpa_lombardia' THEN 30 WHEN 'era5_reanalysis' THEN 300 WHEN 'diy_buoy' THEN 5 ELSE 60 END"
FRESH_AT = "TIMESTAMP '2024-01-31 00:30:00'"
FRESH = f"""fh AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY source ORDER BY checked_at DESC) AS rk FROM fx_source_health) WHERE rk = 1),
fr AS (SELECT source, checked_at AS last_check_at, date_diff('microsecond', checked_at, {FRESH_AT}) / 60e6 AS age, {SLA} AS sla_minutes, ok, latency_ms FROM fh)"""


def fresh_now():
    from sparkmos.functions.common import ts

    return ts("2024-01-31 00:30:00")


@query("f38_freshness", sql(f"WITH {FRESH} SELECT source, last_check_at, {r('age', 1)} AS age_minutes, sla_minutes::BIGINT AS sla_minutes, age <= sla_minutes AS is_fresh, ok FROM fr", "fx_source_health"))
def f38(spark, sf):
    return health.freshness(table(spark, sf, "fx_source_health"), fresh_now())


PENALTY = f"SELECT {r('least(0.5, sum(CASE WHEN age <= sla_minutes THEN 0 WHEN source LIKE ' + repr('open_meteo%') + ' THEN 0.25 WHEN source IN (' + repr('domaso_live') + ', ' + repr('arpa_lombardia') + ') THEN 0.1 ELSE 0.05 END))')} AS penalty FROM fr"


@query("f38_freshness_penalty", sql(f"WITH {FRESH} {PENALTY}", "fx_source_health"))
def f38_penalty(spark, sf):
    return health.freshness_penalty(health.freshness(table(spark, sf, "fx_source_health"), fresh_now()))


@query("d23_source_status", sql(f"""WITH {FRESH} SELECT source, last_check_at, {r('age', 1)} AS age_minutes, age <= sla_minutes AS is_fresh, ok, {doubles('latency_ms')},
  CASE source WHEN 'open_meteo' THEN (SELECT count(*) FROM fx_forecast_runs WHERE model_name NOT LIKE '%_ens') WHEN 'open_meteo_ensemble' THEN (SELECT count(*) FROM fx_forecast_runs WHERE model_name LIKE '%_ens')
    WHEN 'domaso_live' THEN (SELECT count(*) FROM fx_observations WHERE source = 'domaso_live') WHEN 'arpa_lombardia' THEN (SELECT count(*) FROM fx_observations WHERE source LIKE 'arpa_%')
    WHEN 'era5_reanalysis' THEN (SELECT count(*) FROM fx_observations WHERE source = 'era5_reanalysis') ELSE -1 END AS n_rows FROM fr""", "fx_source_health", "fx_forecast_runs", "fx_observations"))
def d23(spark, sf):
    t = lambda n: table(spark, sf, n)
    s = health.source_status(t("fx_source_health"), t("fx_forecast_runs"), t("fx_observations"), fresh_now())
    return s.select("source", "last_check_at", "age_minutes", "is_fresh", "ok", "latency_ms", F.coalesce("n", F.lit(-1)).alias("n_rows"))


