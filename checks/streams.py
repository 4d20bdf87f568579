"""The events file as a stream, run to the end; results equal the batch rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fx import TABLES, _order, _Paths, as_of, doubles, query, r, raw, sql, table
from checks.lookups import PAIRS
from checks.stored import LIMITED, OBS, kept, BAD
from sparkmos import settings as cfg
from sparkmos.functions import decision
from sparkmos.functions.common import ts
from sparkmos.session import scratch_dir
from sparkmos.sources.points import points_df
from sparkmos.streaming import keyed, sources, stateful


def stream(spark, sf, name: str):
    """A projected table over the event file read as a stream."""
    ev = sources.file_stream(spark, sf, raw(spark, sf, "events").schema, glob="events.parquet")
    ev.createOrReplaceTempView("_event_stream")
    p = _Paths(sf)
    p["events"] = "_event_stream"
    ctes = ",\n".join(f"{n} AS ({TABLES[n][1].format_map(p)})" for n in _order((name,)))
    return spark.sql(f"WITH {ctes} SELECT * FROM {name}")


def to_files(df, mode="append"):
    spark = df.sparkSession
    path = scratch_dir(spark)
    sources.run_available(df, mode, path=path)
    return spark.read.schema(df.schema).parquet(path)


@query("t01_stream_ingest", sql(f"SELECT id, source, {', '.join(kept(c) for c in LIMITED)}, CASE WHEN {BAD} THEN 'suspect' ELSE 'ok' END AS quality_flag FROM fx_observations WHERE wind_speed_kn BETWEEN 0 AND 120 OR wind_dir_deg BETWEEN 0 AND 360", "fx_observations"))
def t01(spark, sf):
    return to_files(sources.clean_observations(stream(spark, sf, "fx_observations"))).select("id", "source", *LIMITED, "quality_flag")


@query("t02_stream_deduplicate", sql("SELECT source, date_trunc('hour', timestamp) AS hr, lat, lon, true AS is_its_row FROM fx_observations GROUP BY ALL", "fx_observations"))
def t02(spark, sf):
    """One row per key, and that row is one of the table's own, whole."""
    o = stream(spark, sf, "fx_observations").withColumn("hr", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    kept_rows = to_files(keyed.deduplicate(o, ["source", "hr", "lat", "lon"], "timestamp", "1 hour"))
    own = table(spark, sf, "fx_observations").select("id", "source", "timestamp", "lat", "lon", F.lit(True).alias("is_its_row"))
    found = kept_rows.join(own, ["id", "source", "timestamp", "lat", "lon"], "left")
    return found.select("source", "hr", "lat", "lon", F.coalesce("is_its_row", F.lit(False)).alias("is_its_row"))


@query("t03_stream_upsert", sql(f"""SELECT id, source, hr, {doubles('lat lon')}, {doubles(OBS)} FROM (SELECT *, date_trunc('hour', timestamp) AS hr,
row_number() OVER (PARTITION BY source, date_trunc('hour', timestamp), lat, lon ORDER BY id DESC) AS rn FROM fx_observations) WHERE rn = 1""", "fx_observations"))
def t03(spark, sf):
    o = stream(spark, sf, "fx_observations").withColumn("hr", F.date_trunc("hour", "timestamp").cast("timestamp_ntz")).drop("timestamp")
    path = scratch_dir(spark)
    sources.run_available(o, sink=keyed.upsert_sink(spark, path, ["source", "hr", "lat", "lon"], "hr", order="id"))
    return spark.read.parquet(path).select("id", "source", "hr", "lat", "lon", *OBS.split())


def windowed(spark, sf, slide):
    stats = keyed.source_statistics(stream(spark, sf, "fx_observations"), "timestamp", "2 hours", "1 hour", slide)
    path = scratch_dir(spark)
    sources.run_available(stats, "update", sink=keyed.upsert_sink(spark, path, ["source", "window_start"], "window_start"))
    return spark.read.parquet(path).select("source", "window_start", "window_end", "n", "mean_speed", "newest")


@query("t04_stream_tumbling", sql(f"SELECT source, date_trunc('hour', timestamp) AS window_start, date_trunc('hour', timestamp) + INTERVAL '1' HOUR AS window_end, count(*) AS n, {r('avg(wind_speed_kn)')} AS mean_speed, max(timestamp) AS newest FROM fx_observations GROUP BY ALL", "fx_observations"))
def t04(spark, sf):
    return windowed(spark, sf, None)


@query("t04_stream_sliding", sql(f"""WITH w AS (SELECT *, time_bucket(INTERVAL '15' MINUTE, timestamp) - i * INTERVAL '15' MINUTE AS window_start FROM fx_observations CROSS JOIN range(0, 4) t(i))
SELECT source, window_start, window_start + INTERVAL '1' HOUR AS window_end, count(*) AS n, {r('avg(wind_speed_kn)')} AS mean_speed, max(timestamp) AS newest FROM w GROUP BY ALL""", "fx_observations"))
def t04_sliding(spark, sf):
    return windowed(spark, sf, "15 minutes")


@query("t04_stream_staleness", sql(f"""SELECT source, max(timestamp) AS newest, {r("date_diff('microsecond', max(timestamp), TIMESTAMP '2024-01-31 00:30:00') / 60e6")} AS age_minutes, CASE source WHEN 'domaso_live' THEN 20 WHEN 'era5_reanalysis' THEN 300 WHEN 'diy_buoy' THEN 5 ELSE 60 END::BIGINT AS sla_minutes,
  date_diff('microsecond', max(timestamp), TIMESTAMP '2024-01-31 00:30:00') / 60e6 <= CASE source WHEN 'domaso_live' THEN 20 WHEN 'era5_reanalysis' THEN 300 WHEN 'diy_buoy' THEN 5 ELSE 60 END AS is_fresh FROM fx_observations GROUP BY 1""", "fx_observations"))
def t04_stale(spark, sf):
    return keyed.staleness(windowed(spark, sf, None), ts("2024-01-31 00:30:00"), decision.sla_minutes(F.col("source")))


@query("t05_stream_drop_future", sql(f"SELECT id, source, {doubles('wind_speed_kn')} FROM fx_observations WHERE timestamp <= TIMESTAMP '2024-01-20 13:00:00'", "fx_observations"))
def t05(spark, sf):
    o = sources.drop_future(stream(spark, sf, "fx_observations"), "timestamp", as_of())
    return to_files(sources.with_event_time(o, "timestamp", "1 hour")).select("id", "source", "wind_speed_kn")


#: Rows that the watermark has passed, numbered per key in time order; of the batch twins: all rows.
SETTLED = """e AS (SELECT user_id AS key, event_id AS row_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
WHERE ts < date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL '1' HOUR)"""
T6_RATE = f"""WITH RECURSIVE {SETTLED},
s AS (SELECT key, row_id, us, i, true AS accepted, [us] AS recent FROM e WHERE i = 1 UNION ALL
SELECT key, row_id, us, i, n < 2 AS accepted, CASE WHEN n < 2 THEN list_append(live, us) ELSE live END AS recent FROM (
  SELECT e.*, list_filter(s.recent, lambda t: e.us - t < 3600000000) AS live, len(list_filter(s.recent, lambda t: e.us - t < 3600000000)) AS n FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1))
SELECT key, row_id, accepted FROM s"""
GAP_US = int(cfg.ALERT_COOLDOWN_HOURS * 3_600_000_000)
T6_COOL = f"""WITH RECURSIVE {SETTLED},
s AS (SELECT key, row_id, us, i, true AS fired, us AS last FROM e WHERE i = 1 UNION ALL
SELECT e.key, e.row_id, e.us, e.i, e.us - s.last >= {GAP_US} AS fired, CASE WHEN e.us - s.last >= {GAP_US} THEN e.us ELSE s.last END FROM s JOIN e ON e.key = s.key AND e.i = s.i + 1)
SELECT key, row_id, fired FROM s"""
PASSED = "WHERE ts < date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL '1' HOUR"


@query("t06_stream_rate_limit", T6_RATE)
def t06(spark, sf):
    """Two commands per hour, so that some are refused."""
    return to_files(stateful.rate_limit(stream(spark, sf, "fx_events"), "user_id", "ts", "event_id", per_hour=2)).select("key", "row_id", "accepted")


@query("t06_stream_cool_down", T6_COOL)
def t06_cool(spark, sf):
    return to_files(stateful.cool_down(stream(spark, sf, "fx_events"), "user_id", "ts", "event_id")).select("key", "row_id", "fired")


@query("t06_rate_limit_of_table", T6_RATE.replace(PASSED, ""))
def t06_all(spark, sf):
    return stateful.rate_limit_of(table(spark, sf, "fx_events"), "user_id", "ts", "event_id", per_hour=2).select("key", "row_id", "accepted")


@query("t06_cool_down_of_table", T6_COOL.replace(PASSED, ""))
def t06_cool_all(spark, sf):
    return stateful.cool_down_of(table(spark, sf, "fx_events"), "user_id", "ts", "event_id").select("key", "row_id", "fired")


T7 = sql(f"""WITH w AS (SELECT *, CASE WHEN date_diff('microsecond', lag(timestamp) OVER (PARTITION BY source ORDER BY timestamp), timestamp) < 1800000000 THEN 0 ELSE 1 END AS brk FROM fx_observations WHERE wind_speed_kn >= 10),
g AS (SELECT *, sum(brk) OVER (PARTITION BY source ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS s FROM w),
ses AS (SELECT source, min(timestamp) AS session_start, max(timestamp) + INTERVAL '30' MINUTE AS session_end, count(*) AS n, {r('min(wind_speed_kn)')} AS min_speed, {r('max(wind_speed_kn)')} AS max_speed FROM g GROUP BY source, s)
SELECT * FROM ses WHERE session_end <= date_trunc('milliseconds', (SELECT max(timestamp) FROM w)) - INTERVAL '1' HOUR""", "fx_observations")


@query("t07_stream_sessions", T7)
def t07(spark, sf):
    """Closed sessions only: the last ones wait for the watermark."""
    return to_files(keyed.windy_sessions(stream(spark, sf, "fx_observations"), "timestamp", "1 hour", "30 minutes", 10.0))


T7R = sql(f"""WITH p AS (SELECT *, wind_speed_kn >= 10 AS ok FROM fx_observations WHERE timestamp < date_trunc('milliseconds', (SELECT max(timestamp) FROM fx_observations)) - INTERVAL '1' HOUR),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp, id) - row_number() OVER (PARTITION BY source, ok ORDER BY timestamp, id) AS island, max(CASE WHEN NOT ok THEN timestamp END) OVER (PARTITION BY source) AS last_low FROM p),
runs AS (SELECT source AS key, count(*) AS n, epoch_us(min(timestamp)) AS start_us, epoch_us(max(timestamp)) AS end_us, {r('max(wind_speed_kn)')} AS peak, max(timestamp) AS e, any_value(last_low) AS last_low FROM g WHERE ok GROUP BY source, island)
SELECT key, n, start_us, end_us, peak FROM runs WHERE n >= 3 AND e <= last_low""", "fx_observations")


@query("t07_stream_unbroken_runs", T7R)
def t07_runs(spark, sf):
    return to_files(stateful.sustained_runs(stream(spark, sf, "fx_observations"), "source", "timestamp", "id", "wind_speed_kn", 10.0, 3))


T7ALL = sql(f"""WITH p AS (SELECT *, coalesce(wind_speed_kn >= 10, FALSE) AS ok FROM fx_observations),
g AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY timestamp, id) - row_number() OVER (PARTITION BY source, ok ORDER BY timestamp, id) AS island, max((timestamp, id)) OVER (PARTITION BY source) = (timestamp, id) AS newest FROM p)
SELECT source AS key, count(*) AS n, epoch_us(min(timestamp)) AS start_us, epoch_us(max(timestamp)) AS end_us, {r('max(wind_speed_kn)')} AS peak, bool_or(newest) AS open FROM g WHERE ok GROUP BY source, island HAVING count(*) >= 3""", "fx_observations")


@query("t07_unbroken_runs_of_table", T7ALL)
def t07_runs_all(spark, sf):
    """Finished and open runs."""
    return stateful.sustained_runs_of(table(spark, sf, "fx_observations"), "source", "timestamp", "id", "wind_speed_kn", 10.0, 3)


@query("t08_stream_static", sql(f"SELECT f.id, f.point_id, {doubles('wind_speed_kn lat lon')} FROM fx_forecast_runs f JOIN fx_points p USING (point_id)", "fx_forecast_runs"))
def t08(spark, sf):
    f = stream(spark, sf, "fx_forecast_runs")
    return to_files(keyed.enrich(f, points_df(spark).select("point_id", "lat", "lon"), "point_id")).select("id", "point_id", "wind_speed_kn", "lat", "lon")


@query("t09_stream_verification", sql(f"WITH {PAIRS.split('pairs AS')[0].rstrip().rstrip(',')} SELECT valid_time, obs_time, obs_source AS source, {r('obs_speed')} AS obs_speed FROM obs_at", "fx_predictions", "fx_observations"))
def t09(spark, sf):
    pairs = keyed.nearest_pairs(stream(spark, sf, "fx_predictions"), stream(spark, sf, "fx_observations"), "1 hour")
    path = scratch_dir(spark)
    sources.run_available(pairs, sink=keyed.nearest_sink(path))
    return keyed.nearest_of(spark, path).select("valid_time", "obs_time", "source", "obs_speed")


