"""Payloads, stations, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fx import as_of, doubles, query, r, raw, sql, table
from sparkmos.schemas import CLIMATOLOGY_FIELDS
from sparkmos.sources import backfill, payload, points, stations

HOURS = 6


def _times(bad: str):
    """Six hourly ISO strings from the event's hour; one is unreadable for some events."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(HOURS - 1)),
        lambda i: F.when(F.expr(bad) & (i == 3), F.lit("no time")).otherwise(
            F.date_format(F.col("hr") + F.make_dt_interval(hours=i), "yyyy-MM-dd'T'HH:mm")
        ),
    )


def _values(n: int, f):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f)


def _with_payload(ev, bad: str = "event_id % 7 = 0"):
    """Each event becomes one hourly payload; the speed array is short on purpose."""
    return ev.withColumn(
        "payload",
        F.to_json(
            F.struct(
                F.struct(
                    _times(bad).alias("time"),
                    _values(4, lambda i: F.col("value") + i).alias("wind_speed_10m"),
                    _values(6, lambda i: ((F.col("event_id") * 37 + i * 10) % 361).cast("double")).alias("wind_direction_10m"),
                    _values(6, lambda i: F.when((F.col("event_id") + i) % 5 != 0, F.col("value") * 1.5)).alias("wind_gusts_10m"),
                    _values(6, lambda i: 990.0 + F.col("k") + i).alias("pressure_msl"),
                    _values(6, lambda i: F.col("k") - 5.0 - i).alias("temperature_2m"),
                    _values(6, lambda i: (F.col("event_id") * 7 + i) % 100).alias("weather_code"),
                    _values(2, lambda i: F.col("k") * 1.0).alias("relative_humidity_2m"),
                    _values(6, lambda i: F.col("value") * 2.0 + i).alias("wind_speed_80m"),
                ).alias("hourly")
            )
        ),
    )


def _landed(ev):
    """Payloads land as many files; the shared event table is one."""
    return ev.repartition(ev.sparkSession.sparkContext.defaultParallelism, "event_id")


def payloads(spark, sf):
    ev = table(spark, sf, "fx_events").withColumns(
        {"model_name": F.concat(F.lit("m_"), "event_type"), "point_id": F.concat(F.lit("p_"), F.pmod("user_id", F.lit(11)))}
    )
    return _with_payload(_landed(ev)).select("event_id", "model_name", "point_id", "payload")


HOUR_ROWS = """
hours AS (SELECT e.*, i, hr + i * INTERVAL '1' HOUR AS valid_time FROM fx_events e CROSS JOIN range(0, 6) t(i)
  WHERE NOT (event_id % 7 = 0 AND i = 3))"""
HOUR_COLS = f"""
  {r('CASE WHEN i < 4 THEN value + i END')} AS wind_speed_kn, CAST((event_id * 37 + i * 10) % 361 AS DOUBLE) AS wind_dir_deg,
  {r('CASE WHEN (event_id + i) % 5 <> 0 THEN value * 1.5 END')} AS wind_gust_kn"""

S1 = sql(f"""WITH {HOUR_ROWS}
SELECT event_id, 'm_' || event_type AS model_name, 'p_' || CAST(user_id % 11 AS VARCHAR) AS point_id,
  date_trunc('day', hr) + (hour(hr) // 6 * 6) * INTERVAL '1' HOUR AS run_time, valid_time, {HOUR_COLS},
  CAST(990 + k + i AS DOUBLE) AS pressure_msl, CAST(k - 5 - i AS DOUBLE) AS temperature_2m,
  CAST(NULL AS DOUBLE) AS dew_point_2m, CAST((event_id * 7 + i) % 100 AS BIGINT) AS weather_code,
  {r('value * 2 + i')} AS wind_speed_80m
FROM hours""", "fx_events")


@query("s01_forecast_payload", S1)
def s01(spark, sf):
    rows = payload.forecast_rows(payloads(spark, sf), upper_air=True)
    return rows.select(
        "event_id", "model_name", "point_id", "run_time", "valid_time", "wind_speed_kn", "wind_dir_deg", "wind_gust_kn",
        "pressure_msl", "temperature_2m", "dew_point_2m", "weather_code", "wind_speed_80m",
    )


@query("s02_run_cycle", sql(f"""WITH {HOUR_ROWS}
SELECT date_trunc('day', hr) + (hour(hr) // 6 * 6) * INTERVAL '1' HOUR AS run_time, count(*) AS n, min(valid_time) AS first_valid
FROM hours GROUP BY 1""", "fx_events"))
def s02(spark, sf):
    return payload.forecast_rows(payloads(spark, sf)).groupBy("run_time").agg(
        F.count("*").alias("n"), F.min("valid_time").alias("first_valid")
    )


@query("s03_backfill_payload", sql(f"""WITH {HOUR_ROWS}
SELECT event_id, 'm_' || event_type AS model_name, valid_time - INTERVAL '6' HOUR AS run_time, valid_time, {HOUR_COLS}
FROM hours WHERE i < 4""", "fx_events"))
def s03(spark, sf):
    return payload.backfill_rows(payloads(spark, sf)).select(
        "event_id", "model_name", "run_time", "valid_time", "wind_speed_kn", "wind_dir_deg", "wind_gust_kn"
    )


def ensemble_payloads(spark, sf):
    ev = _landed(table(spark, sf, "fx_events"))

    def member(j: int):
        return _values(6, lambda i: F.when((F.col("event_id") + i + j) % 6 != 0, F.col("value") * (0.8 + 0.1 * j) + i * j))

    def direction(j: int):
        return _values(5, lambda i: F.col("k") * 3.0 + i * j)

    def pressure(j: int):
        return _values(6, lambda i: 1000.0 + F.col("k") * 0.1 * j)

    series = [
        _times("false").alias("time"),
        _values(6, lambda i: F.col("value") + i).alias("wind_speed_10m"),
        _values(6, lambda i: F.col("k") * 3.0).alias("wind_direction_10m"),
        *[member(j).alias(f"wind_speed_10m_member{j:02d}") for j in (1, 2, 3, 4)],
        *[direction(j).alias(f"wind_direction_10m_member{j:02d}") for j in (1, 2)],
        *[pressure(j).alias(f"pressure_msl_member{j:02d}") for j in (1, 2, 3)],
    ]
    return ev.select(
        "event_id",
        F.concat(F.lit("m_"), "event_type").alias("model_name"),
        F.to_json(F.struct(F.struct(*series).alias("hourly"))).alias("payload"),
    )


S4 = sql(f"""WITH hours AS (SELECT e.*, i FROM fx_events e CROSS JOIN range(0, 6) t(i)),
speed AS (SELECT event_id, i, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS rng FROM (
  SELECT event_id, i, CASE WHEN (event_id + i + j) % 6 <> 0 THEN value * (0.8 + 0.1 * j) + i * j END AS v
  FROM hours CROSS JOIN (VALUES (1), (2), (3), (4)) m(j)) GROUP BY ALL),
dirs AS (SELECT event_id, i, avg(v) AS mean, stddev_pop(v) AS std, max(v) - min(v) AS rng FROM (
  SELECT event_id, i, CASE WHEN i < 5 THEN k * 3 + i * j END AS v FROM hours CROSS JOIN (VALUES (1), (2)) m(j)) GROUP BY ALL),
press AS (SELECT event_id, i, stddev_pop(v) AS std FROM (
  SELECT event_id, i, 1000 + k * 0.1::DOUBLE * j AS v FROM hours CROSS JOIN (VALUES (1), (2), (3)) m(j)) GROUP BY ALL)
SELECT h.event_id, 'm_' || event_type || '_ens' AS model_name, TIMESTAMP '2024-01-20 12:00:00' AS run_time,
  hr + h.i * INTERVAL '1' HOUR AS valid_time, {r('value + h.i')} AS wind_speed_kn, CAST(k * 3 AS DOUBLE) AS wind_dir_deg,
  CAST(NULL AS DOUBLE) AS wind_gust_kn, s.n AS n_members,
  {r('s.mean')} AS speed_mean, {r('s.std')} AS speed_std, {r('s.rng')} AS speed_range,
  {r('d.mean')} AS dir_mean, {r('d.std')} AS dir_std, {r('d.rng')} AS dir_range, {r('p.std')} AS press_std
FROM hours h JOIN speed s USING (event_id, i) JOIN dirs d USING (event_id, i) JOIN press p USING (event_id, i)""", "fx_events")


@query("s04_ensemble_payload", S4)
def s04(spark, sf):
    rows = payload.ensemble_rows(ensemble_payloads(spark, sf), as_of())
    return rows.select(
        "event_id", "model_name", "run_time", "valid_time", "wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "spread.n_members",
        *[f"spread.{c}" for c in ("speed_mean", "speed_std", "speed_range", "dir_mean", "dir_std", "dir_range", "press_std")],
    )


@query("s05_reanalysis_payload", sql(f"""WITH {HOUR_ROWS}
SELECT 'era5_reanalysis' AS source, valid_time AS timestamp, p.lat, p.lon, {HOUR_COLS}, CAST(990 + k + i AS DOUBLE) AS pressure,
  CAST(k - 5 - i AS DOUBLE) AS temperature, CASE WHEN i < 2 THEN CAST(k AS DOUBLE) END AS humidity, 'ok' AS quality_flag, CAST(0.75 AS DOUBLE) AS confidence
FROM hours h JOIN fx_points p ON p.idx = h.user_id % 11 WHERE valid_time <= TIMESTAMP '2024-01-20 13:00:00'""", "fx_events", "fx_points"))
def s05(spark, sf):
    ev = table(spark, sf, "fx_events").withColumn("idx", F.pmod("user_id", F.lit(11)))
    located = _with_payload(ev).join(table(spark, sf, "fx_points").select("idx", "lat", "lon"), "idx")
    return payload.reanalysis_observations(located.select("lat", "lon", "payload"), as_of())


@query("s06_climatology_payload", f"""
SELECT 'p_' || CAST(l_suppkey % 11 AS VARCHAR) AS point_id, CAST(l_shipdate AS TIMESTAMP) + i * INTERVAL '1' HOUR AS timestamp,
  {r('(l_quantity + i) * 1.94384')} AS wind_speed_10m, {r('l_extendedprice / 1000')} AS temperature_2m,
  CASE WHEN i = 0 THEN {r('l_discount')} END AS precipitation, CAST(NULL AS DOUBLE) AS cape
FROM lineitem CROSS JOIN range(0, 2) t(i)""")
def s06(spark, sf):
    li = raw(spark, sf, "lineitem")
    hours = F.sequence(F.lit(0), F.lit(1))
    p = li.select(
        F.concat(F.lit("p_"), F.pmod("l_suppkey", F.lit(11))).alias("point_id"),
        F.to_json(
            F.struct(
                F.struct(
                    F.transform(
                        hours,
                        lambda i: F.date_format(
                            F.col("l_shipdate").cast("timestamp_ntz") + F.make_dt_interval(hours=i), "yyyy-MM-dd'T'HH:mm"
                        ),
                    ).alias("time"),
                    F.transform(hours, lambda i: F.col("l_quantity") + i).alias("wind_speed_10m"),
                    F.transform(hours, lambda i: F.col("l_extendedprice") / 1000).alias("temperature_2m"),
                    F.array("l_discount").alias("precipitation"),
                ).alias("hourly")
            )
        ).alias("payload"),
    )
    rows = payload.climatology_rows(p, speed_factor=1.94384)
    assert len(rows.columns) == len(CLIMATOLOGY_FIELDS) + 2
    return rows.select("point_id", "timestamp", "wind_speed_10m", "temperature_2m", "precipitation", "cape")


SENSOR_CASE = """CASE trim(tipologia) WHEN 'Velocità Vento' THEN 'wind_speed' WHEN 'Direzione Vento' THEN 'wind_dir' WHEN 'Raffica Vento' THEN 'wind_gust'
    WHEN 'Temperatura' THEN 'temperature' WHEN 'Umidità Relativa' THEN 'humidity' WHEN 'Pressione' THEN 'pressure' WHEN 'Precipitazione' THEN 'precipitation'
    ELSE (SELECT min_by(v, o) FROM (VALUES (1, 'velocità vento', 'wind_speed'), (2, 'direzione vento', 'wind_dir'), (3, 'raffica vento', 'wind_gust'),
      (4, 'temperatura', 'temperature'), (5, 'umidità relativa', 'humidity'), (6, 'pressione', 'pressure'), (7, 'precipitazione', 'precipitation')) m(o, n, v)
      WHERE contains(lower(trim(tipologia)), n) OR contains(n, lower(trim(tipologia)))) END"""
SENSORS = f"""sensors AS (SELECT * FROM (SELECT CAST(idsensore AS VARCHAR) AS sensor_id, CAST(idstazione AS VARCHAR) AS station_id,
  nomestazione AS station_name, {SENSOR_CASE} AS sensor_type, lat, lng AS lon FROM fx_registry) WHERE sensor_type IS NOT NULL)"""


@query("s07_sensor_lookup", sql(f"""WITH {SENSORS} SELECT sensor_id, station_id, station_name, sensor_type, {doubles('lat lon')} FROM sensors""", "fx_registry"))
def s07(spark, sf):
    return stations.sensor_lookup(table(spark, sf, "fx_registry"))


def readings(spark, sf):
    return table(spark, sf, "fx_events").select(
        F.col("user_id").cast("string").alias("idsensore"),
        F.date_format("hr", "yyyy-MM-dd'T'HH:mm:ss").alias("data"),
        F.when(F.col("event_id") % 23 == 0, F.lit("n/d")).when(F.col("event_id") % 29 == 0, F.lit(None).cast("string"))
        .otherwise(F.col("k").cast("string")).alias("valore"),
        F.when(F.col("event_id") % 13 == 0, F.lit("Non validato")).otherwise(F.lit(" ")).alias("stato"),
        F.col("event_id").alias("arrival"),
    )


S8 = sql(f"""WITH {SENSORS},
long AS (SELECT s.*, hr AS timestamp, event_id, CASE WHEN event_id % 29 = 0 THEN 0.0 ELSE CAST(k AS DOUBLE) END AS v
  FROM fx_events e JOIN sensors s ON s.sensor_id = CAST(e.user_id AS VARCHAR)
  WHERE e.event_id % 23 <> 0 AND e.event_id % 13 <> 0),
wide AS (SELECT station_id, timestamp, arg_min(lat, event_id) AS lat, arg_min(lon, event_id) AS lon,
  {', '.join(f"arg_max(v, event_id) FILTER (WHERE sensor_type = '{t}') AS {t}" for t in ('wind_speed', 'wind_dir', 'wind_gust', 'pressure', 'temperature', 'humidity'))}
  FROM long GROUP BY 1, 2)
SELECT 'arpa_' || station_id AS source, timestamp, {doubles('lat lon')}, {r('wind_speed * 1.94384', 2)} AS wind_speed_kn,
  {r('wind_dir % 360')} AS wind_dir_deg, {r('wind_gust * 1.94384', 2)} AS wind_gust_kn, {doubles('pressure temperature humidity')},
  'ok' AS quality_flag, CAST(0.85 AS DOUBLE) AS confidence FROM wide""", "fx_registry", "fx_events")


@query("s08_station_pivot", S8)
def s08(spark, sf):
    return stations.station_observations(readings(spark, sf), stations.sensor_lookup(table(spark, sf, "fx_registry")))


@query("s09_active_sensors", sql("""SELECT idsensore, tipologia FROM fx_registry
WHERE lat BETWEEN 46.0 - 0.15 AND 46.2 + 0.15 AND lng BETWEEN 9.25 - 0.15 AND 9.35 + 0.15 AND datastop IS NULL""", "fx_registry"))
def s09(spark, sf):
    return stations.active_sensors(table(spark, sf, "fx_registry"), (46.0, 46.2), (9.25, 9.35)).select("idsensore", "tipologia")


@query("s10_recent_readings", sql(f"""WITH {SENSORS} SELECT event_id AS arrival, CAST(user_id AS VARCHAR) AS idsensore FROM fx_events
WHERE hr > TIMESTAMP '2024-01-20 00:00:00' AND CAST(user_id AS VARCHAR) IN (SELECT sensor_id FROM sensors)""", "fx_registry", "fx_events"))
def s10(spark, sf):
    sensors = stations.sensor_lookup(table(spark, sf, "fx_registry"))
    return stations.recent_readings(readings(spark, sf), sensors, as_of()).select("arrival", "idsensore")


DIRS = ["N", "NNE", "E", "SO", "variabile", "45 °", "WNW", "", "sw", "nnw"]


def station_pages(spark, sf):
    """One page per event: a header, a label row and a value row, twice."""
    ev = table(spark, sf, "fx_events")
    name = F.get(F.array(*[F.lit(d) for d in DIRS]), F.pmod("event_id", F.lit(len(DIRS))).cast("int"))
    gust = F.when(F.col("event_id") % 3 == 0, F.lit("")).otherwise(F.concat(F.col("k").cast("string"), F.lit(" km/h")))
    td = lambda c, text: F.concat(F.lit(f'<td class="{c}">'), text, F.lit("</td>"))
    html = F.concat(
        F.lit("<html><body><table><tr><td colspan=3>Meteo</td></tr><tr>"),
        td("des2", F.lit("Vento:")), td("des2", F.lit("Direzione <b>Vento</b>:")), td("des2", F.lit("Raffica vento:")), td("des2", F.lit("Raffica max:")),
        F.lit("</tr><tr>"),
        td("tit2", F.concat(F.lit("<big>"), F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(",")), F.lit("</big> km/h"))),
        td("tit2", name), td("tit2", gust), td("tit2", F.lit("50 km/h")),
        F.lit("</tr><tr>"),
        td("des2", F.lit("Temperatura:")), td("des2", F.lit("Umidita:")), td("des2", F.lit("Pressione:")),
        F.lit("</tr><tr>"),
        td("tit2", F.concat((F.col("k") - 50).cast("string"), F.lit(" °C"))), td("tit2", F.lit("n.d.")),
        td("tit2", F.concat((F.col("k") + 950).cast("string"), F.lit(" Hpa"))),
        F.lit("</tr></table></body></html>"),
    )
    page = F.when(F.col("event_id") % 11 == 0, F.replace(html, F.lit("Vento:"), F.lit("Altro:"))).otherwise(html)
    return ev.select("event_id", page.alias("html"), F.col("ts").alias("fetched_at"))


S11 = sql(f"""WITH p AS (SELECT event_id, ts AS timestamp, {r('value * 0.539957', 3)} AS wind_speed_kn,
  CASE event_id % 10 WHEN 0 THEN 0.0 WHEN 1 THEN 22.5 WHEN 2 THEN 90.0 WHEN 3 THEN 180.0 WHEN 5 THEN 45.0 WHEN 6 THEN 292.5
    WHEN 8 THEN 225.0 WHEN 9 THEN 337.5 END AS wind_dir_deg,
  {r('(CASE WHEN event_id % 3 = 0 THEN 50 ELSE k END) * 0.539957', 3)} AS wind_gust_kn, CAST(k + 950 AS DOUBLE) AS pressure,
  CAST(k - 50 AS DOUBLE) AS temperature, CAST(NULL AS DOUBLE) AS humidity FROM fx_events WHERE event_id % 11 <> 0)
SELECT event_id, 'domaso_live' AS source, timestamp, CAST(46.151 AS DOUBLE) AS lat, CAST(9.332 AS DOUBLE) AS lon, wind_speed_kn,
  CAST(wind_dir_deg AS DOUBLE) AS wind_dir_deg, wind_gust_kn, pressure, temperature, humidity,
  CASE WHEN wind_dir_deg IS NULL THEN 'suspect' ELSE 'ok' END AS quality_flag,
  {r('0.4 + 0.1 * (4 + CASE WHEN wind_dir_deg IS NULL THEN 0 ELSE 1 END)')} AS confidence FROM p""", "fx_events")


@query("s11_station_page", S11)
def s11(spark, sf):
    return stations.page_observations(station_pages(spark, sf))


@query("s11_station_page_crawl", """SELECT count(*) AS n_pages, count(*) FILTER (page_id % 7 = 3) AS n_observations FROM pages""")
def s11_crawl(spark, sf):
    """Every seventh crawled page gets a wind table put in; these pages and no others give observations."""
    wind = F.lit('<table><tr><td class="des2">Vento:</td></tr><tr><td>11&nbsp;km/h</td></tr></table>')
    html = F.when(F.col("page_id") % 7 == 3, F.concat(F.coalesce("html", F.lit("")), wind)).otherwise(F.col("html"))
    pages = raw(spark, sf, "pages").select("page_id", html.alias("html"), as_of().alias("fetched_at"))
    n = stations.page_observations(pages).agg(F.count("*").alias("n")).scalar()
    return pages.agg(F.count("*").alias("n_pages")).withColumn("n_observations", n)


@query("s12_buoy_reading", sql(f"""SELECT event_id, 'diy_buoy' AS source, ts AS timestamp,
  CASE WHEN event_id % 3 = 0 THEN {r('46 + k / 1000.0::DOUBLE')} ELSE 46.1 END AS lat, CAST(9.3 AS DOUBLE) AS lon,
  CASE WHEN event_id % 4 <> 0 THEN {r('value')} END AS wind_speed_kn, CAST(k AS DOUBLE) AS wind_dir_deg,
  CAST(NULL AS DOUBLE) AS wind_gust_kn, CAST(NULL AS DOUBLE) AS pressure, CAST(NULL AS DOUBLE) AS temperature, CAST(NULL AS DOUBLE) AS humidity,
  CASE WHEN event_id % 4 <> 0 THEN 'ok' ELSE 'suspect' END AS quality_flag, CAST(0.95 AS DOUBLE) AS confidence
FROM fx_events WHERE event_id % 9 <> 0""", "fx_events"))
def s12(spark, sf):
    ev = table(spark, sf, "fx_events")
    reading = F.to_json(
        F.struct(
            F.when(F.col("event_id") % 3 == 0, 46 + F.col("k") / 1000.0).alias("lat"),
            F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("wind_speed_kn"),
            F.col("k").alias("wind_dir_deg"),
        )
    )
    rows = ev.select("event_id", F.when(F.col("event_id") % 9 != 0, reading).alias("reading"), F.col("ts").alias("received_at"))
    return stations.buoy_observations(rows)


@query("s13_crowd_report", sql("""WITH b AS (SELECT *, (k % 17) - 1 AS force, CASE event_id % 6 WHEN 0 THEN 'n' WHEN 1 THEN 'SE' WHEN 2 THEN 'XX' WHEN 3 THEN 'w' WHEN 4 THEN 'NW' ELSE 'E' END AS d FROM fx_events)
SELECT 'report_' || CAST(user_id AS VARCHAR) AS source, ts AS timestamp, p.lat, p.lon,
  CAST(list_extract([0, 1, 4, 7, 11, 17, 22, 28, 35, 42, 50, 59, 68], CAST(least(force, 12) + 1 AS BIGINT)) AS DOUBLE) AS wind_speed_kn,
  CAST(CASE upper(d) WHEN 'N' THEN 0 WHEN 'SE' THEN 135 WHEN 'W' THEN 270 WHEN 'NW' THEN 315 WHEN 'E' THEN 90 END AS DOUBLE) AS wind_dir_deg,
  CAST(0.6 AS DOUBLE) AS confidence
FROM b JOIN fx_points p ON p.point_id = CASE WHEN event_id % 4 = 0 THEN 'mid_channel' ELSE 'dongo_shore' END
WHERE event_id % 10 <> 3 AND force >= 0 AND d <> 'XX'""", "fx_events", "fx_points"))
def s13(spark, sf):
    ev = table(spark, sf, "fx_events")
    d = F.get(F.array(*[F.lit(x) for x in ("n", "SE", "XX", "w", "NW", "E")]), F.pmod("event_id", F.lit(6)).cast("int"))
    rows = ev.select(
        "user_id",
        F.col("ts").alias("reported_at"),
        F.when(F.col("event_id") % 10 == 3, F.lit("storm")).otherwise((F.col("k") % 17 - 1).cast("string")).alias("beaufort"),
        d.alias("direction"),
        F.when(F.col("event_id") % 4 != 0, F.lit("dongo_shore")).alias("point_id"),
    )
    out = stations.report_observations(rows, table(spark, sf, "fx_points"))
    return out.select("source", "timestamp", "lat", "lon", "wind_speed_kn", "wind_dir_deg", "confidence")


@query("s14_point_dimension", sql("""SELECT p.idx, p.point_id, p.lat, p.lon, p.is_operational, count(f.id) AS n_forecasts
FROM fx_points p LEFT JOIN fx_forecast_runs f USING (point_id) WHERE p.is_operational GROUP BY ALL""", "fx_forecast_runs"))
def s14(spark, sf):
    n = table(spark, sf, "fx_forecast_runs").groupBy("point_id").agg(F.count("*").alias("n_forecasts"))
    return points.operational(points.points_df(spark)).join(n, "point_id", "left").fillna(0, ["n_forecasts"])


@query("s15_backfill_tasks", sql("""WITH ranges AS (SELECT point_id, min(valid_time) AS "start", max(valid_time) AS "end" FROM fx_forecast_runs GROUP BY 1),
models AS (SELECT unnest(['icon_d2', 'icon_eu', 'ecmwf_ifs025', 'gfs_seamless', 'italia_meteo_arpae_icon_2i']) AS model_name)
SELECT point_id, model_name, "start" + i * INTERVAL '7' DAY AS chunk_start, least("start" + (i + 1) * INTERVAL '7' DAY, "end") AS chunk_end
FROM ranges CROSS JOIN models CROSS JOIN range(0, 10) t(i) WHERE "start" + i * INTERVAL '7' DAY < "end" """, "fx_forecast_runs"))
def s15(spark, sf):
    ranges = table(spark, sf, "fx_forecast_runs").groupBy("point_id").agg(F.min("valid_time").alias("start"), F.max("valid_time").alias("end"))
    return backfill.forecast_tasks(ranges, chunk_days=7).select("point_id", "model_name", "chunk_start", "chunk_end")


@query("s15_deep_chunks", sql("""WITH ranges AS (SELECT point_id, min(timestamp) AS "start", max(timestamp) AS "end" FROM fx_climatology GROUP BY 1)
SELECT point_id, "start" + i * INTERVAL '366' DAY AS chunk_start, least("start" + i * INTERVAL '366' DAY + INTERVAL '365' DAY, "end") AS chunk_end
FROM ranges CROSS JOIN range(0, 20) t(i) WHERE "start" + i * INTERVAL '366' DAY < "end" """, "fx_climatology"))
def s15_deep(spark, sf):
    ranges = table(spark, sf, "fx_climatology").groupBy("point_id").agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
    return backfill.chunks(ranges, "start", "end", 365, gap_days=1).select("point_id", "chunk_start", "chunk_end")


