"""Quality rules (Q), upserts and other table changes (K)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fx import as_of, doubles, query, r, sql, table
from sparkmos import schemas
from sparkmos.functions.common import ts
from sparkmos.operators import quality, tables
from sparkmos.session import scratch_dir

FC = "wind_speed_kn wind_dir_deg wind_gust_kn pressure_msl temperature_2m"
OBS = "wind_speed_kn wind_dir_deg wind_gust_kn pressure temperature humidity"
LIMITED = {"wind_speed_kn": (0, 120), "wind_gust_kn": (0, 150), "wind_dir_deg": (0, 360), "pressure": (850, 1100), "temperature": (-50, 60), "humidity": (0, 100)}
BAD = " OR ".join(f"({c} IS NOT NULL AND {c} NOT BETWEEN {a} AND {b})" for c, (a, b) in LIMITED.items())


def kept(c: str) -> str:
    a, b = LIMITED[c]
    v = f"{c} % 360" if c == "wind_dir_deg" else c
    return r(f"CASE WHEN {c} BETWEEN {a} AND {b} THEN {v} END") + f" AS {c}"


Q1 = sql(f"SELECT id, {', '.join(kept(c) for c in LIMITED)}, CASE WHEN {BAD} THEN 'suspect' ELSE 'ok' END AS quality_flag FROM fx_observations", "fx_observations")


@query("q01_physical_limits", Q1)
def q01(spark, sf):
    return quality.checked_observations(table(spark, sf, "fx_observations")).select("id", *LIMITED, "quality_flag")


@query("q02_direction_range", sql(f"SELECT id, {r('CASE WHEN wind_dir_deg = 360 THEN 0 ELSE wind_dir_deg END')} AS wind_dir_deg FROM fx_observations", "fx_observations"))
def q02(spark, sf):
    return quality.apply_limits(table(spark, sf, "fx_observations"), flag=None).select("id", "wind_dir_deg")


@query("q03_quality_flag", sql(f"SELECT source, CASE WHEN {BAD} THEN 'suspect' ELSE 'ok' END AS quality_flag, count(*) AS n FROM fx_observations GROUP BY ALL", "fx_observations"))
def q03(spark, sf):
    return quality.checked_observations(table(spark, sf, "fx_observations")).groupBy("source", "quality_flag").agg(F.count("*").alias("n"))


HOLED = "SELECT id, CASE WHEN id % 3 <> 0 THEN wind_speed_kn END AS wind_speed_kn, CASE WHEN id % 4 <> 0 THEN wind_dir_deg END AS wind_dir_deg FROM fx_observations"


@query("q04_drop_windless", sql(f"SELECT id, {doubles('wind_speed_kn wind_dir_deg')} FROM ({HOLED}) WHERE wind_speed_kn IS NOT NULL OR wind_dir_deg IS NOT NULL", "fx_observations"))
def q04(spark, sf):
    obs = table(spark, sf, "fx_observations").select(
        "id",
        F.when(F.col("id") % 3 != 0, F.col("wind_speed_kn")).alias("wind_speed_kn"),
        F.when(F.col("id") % 4 != 0, F.col("wind_dir_deg")).alias("wind_dir_deg"),
    )
    return quality.with_wind(obs)


TEXTS = "CASE WHEN event_id % 5 = 0 THEN 'n/a' WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN CAST(k AS VARCHAR) || '.5' ELSE CAST(k AS VARCHAR) END"


@query("q05_safe_number", sql(f"SELECT event_id, TRY_CAST({TEXTS} AS DOUBLE) AS number FROM fx_events", "fx_events"))
def q05(spark, sf):
    ev = table(spark, sf, "fx_events")
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).when(F.col("event_id") % 7 == 0, F.lit(None))
        .when(F.col("event_id") % 3 == 0, F.concat(k, F.lit(".5"))).otherwise(k)
    )
    return ev.select("event_id", text.try_cast("double").alias("number"))


@query("q06_feature_scan", sql(f"""SELECT id, valid_time, {doubles('wind_speed_kn')} FROM fx_forecast_runs
WHERE point_id = 'mid_channel' AND valid_time >= TIMESTAMP '2024-01-05' AND valid_time <= TIMESTAMP '2024-01-20 12:00:00' AND model_name = 'icon_eu'""", "fx_forecast_runs"))
def q06(spark, sf):
    f = table(spark, sf, "fx_forecast_runs").withColumnRenamed("model_name", "feature_set_version")
    return quality.scan_features(f, "mid_channel", ts("2024-01-05 00:00:00"), as_of(), "icon_eu").select("id", "valid_time", "wind_speed_kn")


WITH_ENS = "SELECT CASE WHEN id % 4 = 0 THEN model_name || '_ens' ELSE model_name END AS model_name FROM fx_forecast_runs"


@query("q07_class_counts", sql(f"""SELECT 'open_meteo' AS source, count(*) AS n FROM ({WITH_ENS}) WHERE model_name NOT LIKE '%_ens'
UNION ALL SELECT 'open_meteo_ensemble', count(*) FROM ({WITH_ENS}) WHERE model_name LIKE '%_ens'
UNION ALL SELECT 'domaso_live', count(*) FROM fx_observations WHERE source = 'domaso_live'
UNION ALL SELECT 'arpa_lombardia', count(*) FROM fx_observations WHERE source LIKE 'arpa_%'
UNION ALL SELECT 'era5_reanalysis', count(*) FROM fx_observations WHERE source = 'era5_reanalysis'""", "fx_forecast_runs", "fx_observations"))
def q07(spark, sf):
    from sparkmos.operators import health

    f = table(spark, sf, "fx_forecast_runs")
    f = f.withColumn("model_name", F.when(F.col("id") % 4 == 0, F.concat("model_name", F.lit("_ens"))).otherwise(F.col("model_name")))
    return health.class_counts(f, table(spark, sf, "fx_observations"))


Q8_COLS = "speed small flat cloud holes".split()
Q8_SRC = "SELECT wind_speed_kn AS speed, precipitation / 20 AS small, 1.0::DOUBLE AS flat, cloud_cover AS cloud, CASE WHEN id % 2 = 0 THEN 0.15 END AS holes FROM fx_forecast_runs"


@query("q08_variance_pruning", sql("WITH f AS (" + Q8_SRC + ") " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature FROM f HAVING var_pop(coalesce({c}, 0)) > 0.01" for c in Q8_COLS), "fx_forecast_runs"))
def q08(spark, sf):
    f = table(spark, sf, "fx_forecast_runs").selectExpr(
        "wind_speed_kn AS speed", "precipitation / 20 AS small", "CAST(1 AS DOUBLE) AS flat", "cloud_cover AS cloud",
        "CASE WHEN id % 2 = 0 THEN CAST(0.15 AS DOUBLE) END AS holes",
    )
    names = quality.varying_columns(f, Q8_COLS)
    return spark.createDataFrame([(n,) for n in names], "feature string")


@query("q09_numeric_matrix", sql("SELECT event_id, CAST(k > 50 AS INT)::DOUBLE AS flag, CAST(k AS DOUBLE) AS k, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(k AS VARCHAR) END AS DOUBLE) AS text FROM fx_events", "fx_events"))
def q09(spark, sf):
    ev = table(spark, sf, "fx_events").selectExpr("event_id", "k > 50 AS flag", "k", "CASE WHEN event_id % 5 = 0 THEN 'x' ELSE CAST(k AS STRING) END AS text")
    return quality.numeric_matrix(ev, ["flag", "k", "text"])


# --- K: the newest third of the rows is the batch, the rest is stored. ---

FKEY = ", ".join(schemas.FORECAST_KEY)


@query("k01_upsert_forecasts", sql(f"""WITH split AS (SELECT *, (id % 3 = 0)::INT AS gen FROM fx_forecast_runs),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FKEY} ORDER BY gen DESC, id DESC) AS rn FROM split) WHERE rn = 1),
old AS (SELECT {FKEY}, max(id) AS old_id FROM split WHERE gen = 0 GROUP BY ALL)
SELECT coalesce(old_id, id) AS id, {', '.join('won.' + k for k in schemas.FORECAST_KEY)}, {doubles(FC)} FROM won LEFT JOIN old USING ({FKEY})""", "fx_forecast_runs"))
def k01(spark, sf):
    f = table(spark, sf, "fx_forecast_runs")
    stored = tables.last_wins(f.filter("id % 3 <> 0"), schemas.FORECAST_KEY, "id")
    batch = f.filter("id % 3 = 0").withColumn("seq", F.col("id"))
    return tables.upsert(stored, batch, schemas.FORECAST_KEY, "seq", keep=["id"]).select("id", *schemas.FORECAST_KEY, *FC.split())


@query("k01_upsert_stored", sql(f"""WITH split AS (SELECT *, (id % 3 = 0)::INT AS gen FROM fx_forecast_runs),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {FKEY} ORDER BY gen DESC, id DESC) AS rn FROM split) WHERE rn = 1),
old AS (SELECT {FKEY}, max(id) AS old_id FROM split WHERE gen = 0 GROUP BY ALL)
SELECT coalesce(old_id, id) AS id, {', '.join('won.' + k for k in schemas.FORECAST_KEY)}, {doubles(FC)} FROM won LEFT JOIN old USING ({FKEY})""", "fx_forecast_runs"))
def k01_stored(spark, sf):
    """The same through files: first batch, second batch, and the second once more; old ids stay."""
    f = table(spark, sf, "fx_forecast_runs").withColumn("seq", F.col("id"))
    path = scratch_dir(spark)
    second = f.filter("id % 3 = 0")
    for batch in (f.filter("id % 3 <> 0"), second, second):
        tables.upsert_path(spark, path, batch, schemas.FORECAST_KEY, "seq", "valid_time", keep=["id"])
    return spark.read.parquet(path).select("id", *schemas.FORECAST_KEY, *FC.split())


OKEY = "source, timestamp, lat, lon"
COARSE = "(SELECT * REPLACE (date_trunc('hour', timestamp) AS timestamp) FROM fx_observations)"


@query("k02_upsert_observations", sql(f"""SELECT id, source, timestamp, {doubles('lat lon')}, {doubles(OBS)}, 'ok' AS quality_flag, CAST(1 AS DOUBLE) AS confidence FROM (
SELECT *, row_number() OVER (PARTITION BY {OKEY} ORDER BY (id % 3 = 0)::INT DESC, id DESC) AS rn FROM {COARSE}) WHERE rn = 1""", "fx_observations"))
def k02(spark, sf):
    o = table(spark, sf, "fx_observations").withColumn("timestamp", F.date_trunc("hour", "timestamp").cast("timestamp_ntz"))
    o = tables.observation_defaults(o).withColumn("seq", F.col("id"))
    stored = tables.last_wins(o.filter("id % 3 <> 0"), schemas.OBSERVATION_KEY, "seq").drop("seq")
    return tables.upsert(stored, o.filter("id % 3 = 0"), schemas.OBSERVATION_KEY, "seq")


CLIM_ORDER = "l_orderkey, l_linenumber, wind_speed_10m, temperature_2m, wind_direction_10m, pressure_msl"


@query("k03_insert_or_ignore", sql(f"""WITH stored AS (SELECT DISTINCT point_id, timestamp FROM fx_climatology WHERE l_orderkey % 2 = 0)
SELECT point_id, timestamp, {doubles('wind_speed_10m temperature_2m')}, l_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id, timestamp ORDER BY {CLIM_ORDER}) AS rn FROM fx_climatology WHERE l_orderkey % 2 = 1)
WHERE rn = 1 AND (point_id, timestamp) NOT IN (SELECT (point_id, timestamp) FROM stored)""".replace(
    "AND (point_id, timestamp) NOT IN (SELECT (point_id, timestamp) FROM stored)",
    "AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.point_id = point_id_ AND s.timestamp = ts_)").replace(
    "SELECT *, row_number()", "SELECT *, point_id AS point_id_, timestamp AS ts_, row_number()"), "fx_climatology"))
def k03(spark, sf):
    c = table(spark, sf, "fx_climatology")
    new = tables.insert_or_ignore(
        c.filter("l_orderkey % 2 = 0"), c.filter("l_orderkey % 2 = 1"), schemas.CLIMATOLOGY_KEY, [F.col(x.strip()) for x in CLIM_ORDER.split(",")]
    )
    return new.select("point_id", "timestamp", "wind_speed_10m", "temperature_2m", "l_orderkey")


@query("k04_append", sql(f"""SELECT 'predictions' AS table_name, count(*) AS n, {r('sum(wind_speed_kn)', 3)} AS total FROM fx_predictions
UNION ALL SELECT 'source_health', count(*), {r('sum(latency_ms)', 3)} FROM fx_source_health""", "fx_predictions", "fx_source_health"))
def k04(spark, sf):
    out = []
    for name, df, c, part in (
        ("predictions", table(spark, sf, "fx_predictions"), "wind_speed_kn", "valid_time"),
        ("source_health", table(spark, sf, "fx_source_health"), "latency_ms", "checked_at"),
    ):
        path = scratch_dir(spark)
        dated = df.withColumn("day", F.to_date(part))
        for batch in (dated.filter("pmod(hash(day), 2) = 0"), dated.filter("pmod(hash(day), 2) = 1")):
            tables.append(batch, path, ["day"])
        out.append(spark.read.parquet(path).agg(F.count("*").alias("n"), F.round(F.sum(c), 3).alias("total")).select(F.lit(name).alias("table_name"), "n", "total"))
    return reduce(DataFrame.unionByName, out)


@query("k05_promote", sql("SELECT model_version, model_version = 'Supplier#000000007' AS promoted_to_production FROM fx_model_registry", "fx_model_registry"))
def k05(spark, sf):
    return tables.promote(table(spark, sf, "fx_model_registry"), "Supplier#000000007").select("model_version", "promoted_to_production")


@query("k05_mark_triggered", sql("""SELECT id, threshold_kn, CASE WHEN enabled THEN TIMESTAMP '2024-01-20 12:00:00' ELSE last_triggered_at END AS last_triggered_at FROM fx_alerts""", "fx_alerts"))
def k05_alerts(spark, sf):
    a = table(spark, sf, "fx_alerts")
    changes = a.filter("enabled").select("id", as_of().alias("last_triggered_at"))
    return tables.update_from(a, changes, ["id"]).select("id", "threshold_kn", "last_triggered_at")


@query("k07_delete_owned", sql("SELECT a.id, a.point_id FROM fx_alerts a JOIN fx_users u USING (telegram_user_id) WHERE u.is_allowed", "fx_alerts", "fx_users"))
def k07(spark, sf):
    """Every alert is asked to be deleted, but only for users no longer allowed by its owner."""
    a = table(spark, sf, "fx_alerts")
    asked = a.join(table(spark, sf, "fx_users"), "telegram_user_id").select(
        "id", (F.col("telegram_user_id") + F.when(F.col("is_allowed"), 1).otherwise(0)).alias("telegram_user_id")
    )
    return tables.delete_owned(a, asked, ["id", "telegram_user_id"]).select("id", "point_id")
