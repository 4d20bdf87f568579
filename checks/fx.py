"""Domain tables projected from the shared test tables.

The same text runs in both engines: ``{events}`` and the like become a Parquet path in Spark
and a view name in the SQL engine, ``{TS}`` the zone-less timestamp type of each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkmos.functions.common import ts
from sparkmos.session import prepare

AS_OF = "2024-01-20 12:00:00"
START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
YEARS_BACK = 6

TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_points": ((), """
SELECT CAST(idx AS BIGINT) AS idx, point_id, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, idx < 7 AS is_operational
FROM (VALUES (0,'dongo_shore',46.1230,9.2850),(1,'gravedona_shore',46.1460,9.3050),(2,'domaso_offshore',46.1500,9.3230),
  (3,'mid_channel',46.1000,9.3040),(4,'piona_entrance',46.1140,9.3100),(5,'dervio_shore',46.0763,9.2980),
  (6,'bellano_offshore',46.0550,9.3000),(7,'zurich',47.376,8.541),(8,'milano_linate',45.445,9.278),
  (9,'sondrio',46.170,9.870),(10,'lugano',46.005,8.952)) t(idx, point_id, lat, lon)"""),
    "fx_events": ((), """
SELECT event_id, ts, user_id, event_type, value, props,
  CAST(replace(replace(props, '{{"k": ', ''), '}}', '') AS INT) AS k, CAST(date_trunc('hour', ts) AS {TS}) AS hr
FROM {events}"""),
    "fx_forecast_runs": (("fx_points", "fx_events"), """
SELECT e.event_id AS id,
  CASE e.event_type WHEN 'click' THEN 'icon_eu' WHEN 'view' THEN 'icon_d2' WHEN 'purchase' THEN 'ecmwf_ifs025'
       WHEN 'signup' THEN 'gfs_seamless' ELSE 'italia_meteo_arpae_icon_2i' END AS model_name,
  p.point_id, e.hr - (6 * (1 + e.event_id % 4)) * INTERVAL '1' HOUR AS run_time, e.hr AS valid_time,
  e.value / 10 AS wind_speed_kn,
  CASE WHEN e.event_id % 19 = 0 THEN NULL ELSE CAST((e.event_id * 37) % 361 AS DOUBLE) END AS wind_dir_deg,
  e.value / 10 * (1 + CAST(e.event_id % 9 AS DOUBLE) / 10) AS wind_gust_kn,
  CASE WHEN e.event_id % 17 = 0 THEN NULL ELSE 990 + CAST(e.k AS DOUBLE) / 2 END AS pressure_msl,
  CAST(e.k AS DOUBLE) / 2 - 5 AS temperature_2m, CAST(e.k AS DOUBLE) / 2 - 5 - e.event_id % 16 AS dew_point_2m,
  CAST(e.k AS DOUBLE) AS cloud_cover, CAST((e.event_id * 13) % 900 AS DOUBLE) AS shortwave_radiation,
  CAST((e.event_id * 29) % 2500 AS DOUBLE) AS cape, CAST((e.event_id * 17) % 2400 AS DOUBLE) AS boundary_layer_height,
  CAST(e.event_id % 7 AS DOUBLE) / 2 AS precipitation, CAST((e.event_id * 7) % 100 AS INT) AS weather_code,
  CAST(200 + (e.event_id * 31) % 20000 AS DOUBLE) AS visibility
FROM fx_events e JOIN fx_points p ON p.idx = e.user_id % 11"""),
    "fx_observations": (("fx_events",), """
SELECT event_id AS id,
  CASE WHEN event_id % 50 = 7 THEN 'lake_water_temp' WHEN user_id % 5 = 0 THEN 'domaso_live' WHEN user_id % 5 = 1 THEN 'arpa_101'
       WHEN user_id % 5 = 2 THEN 'arpa_102' WHEN user_id % 5 = 3 THEN 'era5_reanalysis' ELSE 'diy_buoy' END AS source,
  ts AS timestamp, 46 + CAST(4 + user_id % 13 AS DOUBLE) / 100 AS lat, 9 + CAST(27 + user_id % 7 AS DOUBLE) / 100 AS lon,
  value / 3 AS wind_speed_kn, CAST((event_id * 53) % 361 AS DOUBLE) AS wind_dir_deg, value / 2 AS wind_gust_kn,
  845 + CAST(k AS DOUBLE) * 2 AS pressure, CAST(k AS DOUBLE) / 2 - 5 AS temperature, CAST(k + 5 AS DOUBLE) AS humidity
FROM fx_events"""),
    "fx_climatology": (("fx_points",), """
SELECT p.point_id, CAST(l_shipdate AS {TS}) + INTERVAL '8036' DAY + (l_partkey % 24) * INTERVAL '1' HOUR AS timestamp,
  l_quantity / 2 AS wind_speed_10m, CAST((l_partkey * 7) % 360 AS DOUBLE) AS wind_direction_10m,
  l_extendedprice / 3000 AS temperature_2m, 980 + l_discount * 400 AS pressure_msl, l_orderkey, l_linenumber
FROM {lineitem} JOIN fx_points p ON p.idx = l_suppkey % 11"""),
    "fx_predictions": (("fx_points", "fx_events"), """
SELECT e.event_id AS id, p.point_id, e.ts AS generated_at, e.hr + (e.event_id % 25) * INTERVAL '1' HOUR AS valid_time,
  CASE WHEN e.event_id % 10 = 0 THEN 'raw_icon_eu' ELSE 'mos_v1' END AS model_version, e.value / 6 AS wind_speed_kn,
  CAST((e.event_id * 41) % 360 AS DOUBLE) AS wind_dir_deg, e.value / 4 AS wind_gust_kn, CAST(e.k AS DOUBLE) AS confidence_pct,
  CAST(5 + e.event_id % 30 AS DOUBLE) / 10 AS expected_error_kn
FROM fx_events e JOIN fx_points p ON p.idx = e.user_id % 11"""),
    "fx_source_health": ((), """
SELECT CASE user_id % 6 WHEN 0 THEN 'open_meteo' WHEN 1 THEN 'open_meteo_ensemble' WHEN 2 THEN 'domaso_live'
       WHEN 3 THEN 'arpa_lombardia' WHEN 4 THEN 'era5_reanalysis' ELSE 'diy_buoy' END AS source,
  ts AS checked_at, event_type <> 'error' AS ok, value AS latency_ms, CASE WHEN event_type = 'error' THEN props ELSE '' END AS error_msg
FROM {events}"""),
    "fx_users": (("fx_points",), """
SELECT c_custkey AS telegram_user_id, CASE c_nationkey % 3 WHEN 0 THEN 'Europe/Rome' WHEN 1 THEN 'UTC' ELSE 'America/New_York' END AS timezone,
  CASE WHEN c_custkey % 2 = 0 THEN '22:00' ELSE '14:00' END AS quiet_hours_start,
  CASE WHEN c_custkey % 2 = 0 THEN '07:00' ELSE '18:00' END AS quiet_hours_end, c_acctbal > 0 AS is_allowed,
  CASE c_custkey % 3 WHEN 0 THEN 'kn' WHEN 1 THEN 'ms' ELSE 'kmh' END AS units, p.point_id AS favorite_point_id,
  CAST('2024-01-20 12:00:00' AS {TS}) - (c_custkey % 400) * INTERVAL '1' HOUR AS last_seen_at
FROM {customer} JOIN fx_points p ON p.idx = c_custkey % 7"""),
    "fx_alerts": (("fx_points",), """
SELECT c_custkey AS id, c_custkey AS telegram_user_id, p.point_id, CAST(1 + c_custkey % 8 AS DOUBLE) AS threshold_kn,
  CAST(60 * (1 + c_custkey % 3) AS INT) AS min_duration_minutes, CAST(6 + c_custkey % 18 AS INT) AS lead_window_hours, c_custkey % 5 <> 0 AS enabled,
  CASE WHEN c_custkey % 4 = 0 THEN CAST('2024-01-20 12:00:00' AS {TS}) - (c_custkey % 12) * INTERVAL '1' HOUR ELSE NULL END AS last_triggered_at
FROM {customer} JOIN fx_points p ON p.idx = c_custkey % 7"""),
    "fx_subscriptions": ((), """
SELECT c_custkey + 1000000 AS id, c_custkey AS telegram_user_id,
  CASE c_custkey % 6 WHEN 0 THEN '13:15' WHEN 1 THEN '07:00' WHEN 2 THEN '12:30' WHEN 3 THEN '06:45' WHEN 4 THEN '12:00' ELSE '14:00' END AS local_time,
  c_custkey % 7 <> 0 AS enabled,
  CASE WHEN c_custkey % 4 = 0 THEN CAST('2024-01-20 12:00:00' AS {TS}) - (c_custkey % 30) * INTERVAL '1' HOUR ELSE NULL END AS last_sent_at
FROM {customer}"""),
    "fx_model_registry": ((), """
SELECT s_name AS model_version, CAST('2024-01-01 00:00:00' AS {TS}) + s_suppkey * INTERVAL '1' HOUR AS trained_at,
  CAST(1 + s_suppkey % 5 AS DOUBLE) / 2 AS backtest_mae_kn, CAST(10 + s_suppkey % 40 AS DOUBLE) AS backtest_dir_error_deg,
  s_suppkey = 3 AS promoted_to_production
FROM {supplier}"""),
    "fx_registry": ((), """
SELECT c_custkey AS idsensore, c_nationkey AS idstazione, c_name AS nomestazione,
  45.9 + CAST(c_custkey % 60 AS DOUBLE) / 100 AS lat, 9.0 + CAST(c_custkey % 70 AS DOUBLE) / 100 AS lng,
  CASE c_custkey % 10 WHEN 0 THEN 'Velocità Vento' WHEN 1 THEN 'Direzione Vento' WHEN 2 THEN 'raffica vento massima'
    WHEN 3 THEN ' Temperatura ' WHEN 4 THEN 'Umidità' WHEN 5 THEN 'Pressione' WHEN 6 THEN 'Livello Neve'
    WHEN 7 THEN 'VELOCITÀ VENTO' WHEN 8 THEN 'vento' ELSE 'Precipitazione' END AS tipologia,
  CASE WHEN c_custkey % 11 = 0 THEN '2020-01-01' ELSE NULL END AS datastop
FROM {customer}"""),
}


def _order(names: tuple[str, ...]) -> list[str]:
    seen: list[str] = []

    def visit(n: str) -> None:
        if n not in seen:
            for d in TABLES[n][0]:
                visit(d)
            seen.append(n)

    for n in names:
        visit(n)
    return seen


class _Paths(dict):
    def __init__(self, sf: str | None):
        super().__init__(TS="TIMESTAMP_NTZ" if sf else "TIMESTAMP")
        self.sf = sf

    def __missing__(self, key: str) -> str:
        return f"parquet.`{self.sf}/{key}.parquet`" if self.sf else key


def with_clause(names: tuple[str, ...], sf: str | None = None) -> str:
    p = _Paths(sf)
    return ",\n".join(f"{n} AS ({TABLES[n][1].format_map(p)})" for n in _order(names))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A projected table as a Spark DataFrame."""
    prepare(spark)
    return spark.sql(f"WITH {with_clause((name,), sf)} SELECT * FROM {name}")


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A shared table as it is."""
    prepare(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sql(body: str, *names: str) -> str:
    """SQL for the other engine, with the projections it uses in front."""
    head = with_clause(names)
    if not head:
        return body
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head},\n{body.lstrip()[5:]}"
    return f"WITH {head}\n{body}"


def r(x: str, n: int = 6) -> str:
    """SQL for half-up rounding on a decimal, as ``rnd`` does it on the Spark side."""
    return f"(CAST(round(CAST(round({x}, 9) AS DECIMAL(30, 9)), {n}) AS DOUBLE) + 0.0)"


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, integers widened, dates as text, so that the two engines compare equal."""
    cols: list[str] = []
    for name, kind in df.dtypes:
        c = f"`{name}`"
        if kind in ("double", "float"):
            cols.append(f"round(round(CAST({c} AS DOUBLE), 9), {digits}) + 0D AS {c}")
        elif kind in ("int", "smallint", "tinyint"):
            cols.append(f"CAST({c} AS BIGINT) AS {c}")
        elif kind == "date":
            cols.append(f"CAST({c} AS STRING) AS {c}")
        else:
            cols.append(c)
    return df.selectExpr(*cols)


def doubles(names: str, digits: int = 6, prefix: str = "") -> str:
    """Select list rounding every named column."""
    return ", ".join(f"{r(prefix + n, digits)} AS {n}" for n in names.split())


as_of = lambda: ts(AS_OF)


def session(spark: SparkSession) -> SparkSession:
    """The library's settings; in local mode also as many shuffle partitions as threads.

    A cluster keeps its own number. Streaming state in particular is opened once per
    partition, which hundreds of partitions on one machine would only slow down.
    """
    prepare(spark)
    if spark.sparkContext.master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(max(4, spark.sparkContext.defaultParallelism)))
    return spark

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; its result is tidied."""

    def add(fn):
        REGISTRY[name] = (lambda spark, sf: tidy(fn(session(spark), sf)), oracle)
        return fn

    return add
