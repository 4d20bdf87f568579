"""Sensor networks, station pages, buoy readings and crowd reports to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.functions import text, wind
from sparkmos.functions.common import iso_time, lookup

# --- Fixed values: sensor types, page labels, positions, confidences. ---
SENSOR_TYPES = {
    "Velocità Vento": "wind_speed",
    "Direzione Vento": "wind_dir",
    "Raffica Vento": "wind_gust",
    "Temperatura": "temperature",
    "Umidità Relativa": "humidity",
    "Pressione": "pressure",
    "Precipitazione": "precipitation",
}
INVALID_STATES = ["non validato", "invalid", "error"]
STATION_COLUMNS = ["wind_speed", "wind_dir", "wind_gust", "pressure", "temperature", "humidity"]
PAGE_LABELS = [
    "situazione", "temperatura", "temperatura min", "temperatura max", "vento", "direzione vento",
    "raffica vento", "raffica max", "pioggia", "pioggia/h", "pioggia mese", "pioggia anno",
    "umidità", "umidita", "pressione", "uv", "irraggiamento",
]
PAGE_LAT, PAGE_LON = 46.151, 9.332
BUOY_LAT, BUOY_LON = 46.100, 9.300
# --- End of fixed values. ---


def active_sensors(registry: DataFrame, lat: tuple[float, float], lon: tuple[float, float], pad: float = 0.15) -> DataFrame:
    """Registry rows inside the padded box that have not been switched off."""
    return registry.filter(
        F.col("lat").between(lat[0] - pad, lat[1] + pad)
        & F.col("lng").between(lon[0] - pad, lon[1] + pad)
        & F.col("datastop").isNull()
    )


def sensor_lookup(registry: DataFrame) -> DataFrame:
    """Sensor id to station and sensor type; unknown types are dropped.

    An exact type name wins, else the first name contained in the text or containing it.
    """
    name = F.trim(F.coalesce("tipologia", F.lit("")))
    partial = F.lit(None).cast("string")
    for key, value in reversed(SENSOR_TYPES.items()):
        hit = F.lower(name).contains(key.lower()) | F.lit(key.lower()).contains(F.lower(name))
        partial = F.when(hit, F.lit(value)).otherwise(partial)
    return registry.select(
        F.col("idsensore").cast("string").alias("sensor_id"),
        F.coalesce(F.col("idstazione").cast("string"), F.lit("")).alias("station_id"),
        F.coalesce("nomestazione", F.lit("")).alias("station_name"),
        F.coalesce(lookup(SENSOR_TYPES, name), partial).alias("sensor_type"),
        F.col("lat").try_cast("double").alias("lat"),
        F.col("lng").try_cast("double").alias("lon"),
    ).filter("sensor_type IS NOT NULL AND coalesce(sensor_id, '') <> ''")


def recent_readings(readings: DataFrame, sensors: DataFrame, as_of: Column, hours: int = 12) -> DataFrame:
    """Readings of the last hours of known sensors."""
    since = as_of - F.make_dt_interval(hours=F.lit(hours))
    known = sensors.select(F.col("sensor_id").alias("idsensore")).distinct()
    return readings.filter(iso_time("data") > since).join(known, "idsensore", "left_semi")


def station_observations(readings: DataFrame, sensors: DataFrame, order: str = "arrival") -> DataFrame:
    """Long sensor readings (idsensore, data, valore, stato) to one row per station and time.

    ``order`` names the arrival order; the last reading of a type wins. A missing value
    reads as zero, an unreadable one drops the reading.
    """
    state = F.lower(F.trim(F.coalesce("stato", F.lit(""))))
    value = F.coalesce(F.nullif(F.col("valore"), F.lit("")), F.lit("0")).try_cast("double")
    long = (
        readings.filter(~state.isin(*INVALID_STATES))
        .select(
            F.col("idsensore").alias("sensor_id"),
            iso_time("data").alias("timestamp"),
            value.alias("value"),
            F.col(order).alias("_order"),
        )
        .filter("timestamp IS NOT NULL AND value IS NOT NULL")
        .join(sensors, "sensor_id")
    )
    # Station attributes come from the first reading that arrived, values from the last.
    wide = long.groupBy("station_id", "timestamp").agg(
        F.min_by("lat", "_order").alias("lat"),
        F.min_by("lon", "_order").alias("lon"),
        *[
            F.max_by("value", F.when(F.col("sensor_type") == t, F.col("_order"))).alias(t)
            for t in STATION_COLUMNS
        ],
    )
    return wide.select(
        F.concat(F.lit("arpa_"), "station_id").alias("source"),
        "timestamp",
        "lat",
        "lon",
        wind.ms_to_kn(F.col("wind_speed")).alias("wind_speed_kn"),
        F.pmod("wind_dir", F.lit(360.0)).alias("wind_dir_deg"),
        wind.ms_to_kn(F.col("wind_gust")).alias("wind_gust_kn"),
        "pressure",
        "temperature",
        "humidity",
        F.lit("ok").alias("quality_flag"),
        F.lit(0.85).alias("confidence"),
    )


# Entities that the pages use.
ENTITIES = {"&nbsp;": " ", "&#160;": " ", "&deg;": "°", "&#176;": "°", "&agrave;": "à", "&egrave;": "è", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def _unescaped(c: Column) -> Column:
    for entity, character in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


def wind_table(html: Column) -> Column:
    """The rows of the first table that holds the wind label; of a page without tables, all."""
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)
    return F.coalesce(F.get(F.filter(tables, lambda t: t.contains("Vento:")), F.lit(0)), html)


def page_values(html: Column) -> Column:
    """Array of (label, value) of a station page: label rows are followed by value rows.

    A fold over the rows of the wind table: a row with a known label is remembered, the next
    row gives its values cell by cell.
    """

    def cells(row: Column) -> Column:
        raw = F.regexp_extract_all(row, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1)
        strip = lambda c: F.trim(F.regexp_replace(_unescaped(F.regexp_replace(c, r"<[^>]+>", " ")), r"\s+", " "))
        return F.transform(raw, strip)

    def label(cell: Column) -> Column:
        name = F.lower(F.trim(F.regexp_replace(F.trim(cell), r":+$", "")))
        return F.when(name.isin(*PAGE_LABELS), F.when(name == "umidita", F.lit("umidità")).otherwise(name))

    def step(state: Column, row: Column) -> Column:
        found = F.transform(row, label)
        has = F.exists(found, lambda x: x.isNotNull())
        pairs = F.filter(
            F.zip_with(state["labels"], row, lambda k, v: F.struct(k.alias("label"), v.alias("value"))),
            lambda p: p["label"].isNotNull() & (F.coalesce(p["value"], F.lit("")) != ""),
        )
        none = F.array().cast("array<string>")
        waiting = F.size(state["labels"]) > 0
        return F.struct(
            F.when(waiting, none).when(has, found).otherwise(none).alias("labels"),
            F.when(waiting, F.concat(state["pairs"], pairs)).otherwise(state["pairs"]).alias("pairs"),
        )

    rows = F.transform(F.regexp_extract_all(wind_table(html), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), cells)
    start = F.struct(
        F.array().cast("array<string>").alias("labels"),
        F.array().cast("array<struct<label:string,value:string>>").alias("pairs"),
    )
    return F.aggregate(rows, start, step, lambda s: s["pairs"])


def page_observations(pages: DataFrame, html: str = "html", fetched_at: str = "fetched_at") -> DataFrame:
    """Raw station pages to observations; pages without a wind label give no row."""
    has_table = F.col(html).rlike(r"(?is)<td[^>]*class=[\"'][^\"']*\bdes2\b[^\"']*[\"'][^>]*>\s*(?:<[^>]+>\s*)*Vento:\s*(?:<[^>]+>\s*)*</td>")
    parsed = pages.filter(has_table).withColumn("_pairs", page_values(F.col(html)))

    def of(name: str) -> Column:
        hits = F.filter("_pairs", lambda p: p["label"] == name)
        return F.try_element_at(hits, F.lit(-1))["value"]

    number = lambda n: text.number_in(of(n))
    keep = [c for c in pages.columns if c not in (html, fetched_at)]
    rows = parsed.select(
        *keep,
        F.lit("domaso_live").alias("source"),
        F.col(fetched_at).alias("timestamp"),
        F.lit(PAGE_LAT).alias("lat"),
        F.lit(PAGE_LON).alias("lon"),
        wind.kmh_to_kn(number("vento")).alias("wind_speed_kn"),
        text.cardinal_deg(of("direzione vento")).alias("wind_dir_deg"),
        wind.kmh_to_kn(F.coalesce(number("raffica vento"), number("raffica max"))).alias("wind_gust_kn"),
        number("pressione").alias("pressure"),
        number("temperatura").alias("temperature"),
        number("umidità").alias("humidity"),
    )
    fields = ["wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "pressure", "temperature", "humidity"]
    n_ok = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    good = F.col("wind_speed_kn").isNotNull() & F.col("wind_dir_deg").isNotNull()
    return rows.withColumns(
        {
            "quality_flag": F.when(good, F.lit("ok")).otherwise(F.lit("suspect")),
            "confidence": F.round(F.least(F.lit(0.95), 0.4 + 0.1 * n_ok), 9),
        }
    )


BUOY_SCHEMA = (
    "struct<lat: double, lon: double, wind_speed_kn: double, wind_dir_deg: double, wind_gust_kn: double, "
    "pressure: double, temperature: double, humidity: double>"
)


def buoy_observations(raw: DataFrame, reading: str = "reading", received_at: str = "received_at", source: str = "diy_buoy") -> DataFrame:
    keep = [c for c in raw.columns if c not in (reading, received_at)]
    r = raw.withColumn("_r", F.from_json(reading, BUOY_SCHEMA)).filter("_r IS NOT NULL")
    return r.select(
        *keep,
        F.lit(source).alias("source"),
        F.col(received_at).alias("timestamp"),
        F.coalesce("_r.lat", F.lit(BUOY_LAT)).alias("lat"),
        F.coalesce("_r.lon", F.lit(BUOY_LON)).alias("lon"),
        *[f"_r.{c}" for c in ("wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "pressure", "temperature", "humidity")],
        F.when(F.col("_r.wind_speed_kn").isNotNull(), F.lit("ok")).otherwise(F.lit("suspect")).alias("quality_flag"),
        F.lit(0.95).alias("confidence"),
    )


def report_observations(reports: DataFrame, points: DataFrame, default_point: str = "mid_channel") -> DataFrame:
    """Crowd reports (user_id, reported_at, beaufort, direction, point_id) to observations.

    Unknown directions and forces that are not numbers are rejected.
    """
    force = F.col("beaufort").try_cast("int")
    degrees = wind.name_8_to_deg(F.col("direction"))
    located = reports.withColumn("point_id", F.coalesce("point_id", F.lit(default_point))).join(
        points.select("point_id", "lat", "lon"), "point_id"
    )
    return located.filter(force.isNotNull() & (force >= 0) & degrees.isNotNull()).select(
        F.concat(F.lit("report_"), F.col("user_id").cast("string")).alias("source"),
        F.col("reported_at").alias("timestamp"),
        "lat",
        "lon",
        wind.beaufort_to_kn(force).alias("wind_speed_kn"),
        degrees.alias("wind_dir_deg"),
        *[F.lit(None).cast("double").alias(c) for c in ("wind_gust_kn", "pressure", "temperature", "humidity")],
        F.lit("ok").alias("quality_flag"),
        F.lit(0.6).alias("confidence"),
    )
