"""Hourly API payloads (JSON text) to rows.

A payload is ``{"hourly": {"time": [...], "<variable>": [...], ...}}`` with parallel
arrays that may be short. The time array is exploded by position and every variable is
read at that position, which gives NULL beyond its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.functions.common import iso_time, trunc_ntz
from sparkmos.functions.timefn import to_utc
from sparkmos.schemas import CLIMATOLOGY_FIELDS, FORECAST_FIELDS, UPPER_AIR_FIELDS

# --- Fixed values: payload variable -> column. ---
FORECAST_VARIABLES = {
    "wind_speed_10m": "wind_speed_kn",
    "wind_direction_10m": "wind_dir_deg",
    "wind_gusts_10m": "wind_gust_kn",
    **{n: n for n in FORECAST_FIELDS[3:]},
}
OBSERVATION_VARIABLES = {
    "wind_speed_10m": "wind_speed_kn",
    "wind_direction_10m": "wind_dir_deg",
    "wind_gusts_10m": "wind_gust_kn",
    "pressure_msl": "pressure",
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
}
MEMBER_VARIABLES = {
    "speed": "wind_speed_10m",
    "dir": "wind_direction_10m",
    "gust": "wind_gusts_10m",
    "press": "pressure_msl",
}
# --- End of fixed values. ---


def _explode_hours(raw: DataFrame, variables: list[str], payload: str, tz: str | None) -> DataFrame:
    """One row per hour with the variables as columns; unreadable times are dropped."""
    fields = ", ".join(f"`{v}`: array<double>" for v in variables)
    parsed = raw.withColumn("_h", F.from_json(payload, f"struct<hourly: struct<time: array<string>, {fields}>>")["hourly"])
    keep = [c for c in raw.columns if c != payload]
    hours = parsed.select(
        *keep,
        "_h",
        iso_time(F.get(F.col("_h.time"), F.lit(0))).alias("_first"),
        F.posexplode("_h.time").alias("_pos", "_time"),
    )
    rows = hours.select(
        *keep,
        iso_time("_time").alias("valid_time"),
        "_first",
        *[F.get(F.col(f"_h.`{v}`"), F.col("_pos")).alias(v) for v in variables],
    ).filter("valid_time IS NOT NULL")
    if tz:
        rows = rows.withColumns({c: to_utc(c, tz) for c in ("valid_time", "_first")})
    return rows


def _cycle(t: Column) -> Column:
    """Start of the six-hour model cycle containing ``t``."""
    return trunc_ntz("day", t) + F.make_dt_interval(hours=(F.floor(F.hour(t) / 6) * 6).cast("int"))


def forecast_rows(raw: DataFrame, as_of: Column | None = None, payload: str = "payload", tz: str | None = None, upper_air: bool = False) -> DataFrame:
    """Forecast payloads (point_id, model_name, payload) to forecast rows.

    The run time is the six-hour cycle of the first hour (of ``as_of`` when that hour is
    unreadable). ``upper_air`` also keeps the winds and temperatures aloft.
    """
    extra = UPPER_AIR_FIELDS if upper_air else []
    rows = _explode_hours(raw, [*FORECAST_VARIABLES, *extra], payload, tz)
    first = F.col("_first") if as_of is None else F.coalesce("_first", as_of)
    return _as_forecasts(rows.withColumn("run_time", _cycle(first)).drop("_first"))


def backfill_rows(raw: DataFrame, payload: str = "payload", tz: str | None = None) -> DataFrame:
    """Historical payloads: the run time is six hours before the valid time; rows need a speed."""
    rows = _explode_hours(raw, list(FORECAST_VARIABLES), payload, tz).drop("_first")
    rows = rows.withColumn("run_time", F.col("valid_time") - F.expr("INTERVAL '6' HOUR"))
    return _as_forecasts(rows).filter("wind_speed_kn IS NOT NULL")


def _as_forecasts(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({k: v for k, v in FORECAST_VARIABLES.items() if k != v}).withColumn(
        "weather_code", F.col("weather_code").cast("int")
    )


def reanalysis_observations(raw: DataFrame, as_of: Column, payload: str = "payload") -> DataFrame:
    """Reanalysis payloads (point_id, lat, lon, payload) to observations, without future rows."""
    rows = _explode_hours(raw, list(OBSERVATION_VARIABLES), payload, None)
    return (
        rows.filter(F.col("valid_time") <= as_of + F.expr("INTERVAL '1' HOUR"))
        .withColumnsRenamed(OBSERVATION_VARIABLES)
        .select(
            F.lit("era5_reanalysis").alias("source"),
            F.col("valid_time").alias("timestamp"),
            "lat",
            "lon",
            *OBSERVATION_VARIABLES.values(),
            F.lit("ok").alias("quality_flag"),
            F.lit(0.75).alias("confidence"),
        )
    )


def climatology_rows(raw: DataFrame, payload: str = "payload", speed_factor: float = 1.0) -> DataFrame:
    """Climatology payloads (point_id, payload) to rows; ``speed_factor`` converts speeds to knots."""
    rows = _explode_hours(raw, CLIMATOLOGY_FIELDS, payload, None)
    speeds = {"wind_speed_10m", "wind_gusts_10m"} if speed_factor != 1.0 else set()
    return rows.select(
        "point_id",
        F.col("valid_time").alias("timestamp"),
        *[(F.col(c) * speed_factor).alias(c) if c in speeds else F.col(c) for c in CLIMATOLOGY_FIELDS],
    )


def add_member_stats(df: DataFrame, members: dict[str, str]) -> DataFrame:
    """For every (prefix, array column): count, mean, population deviation and range.

    Three stages, so that the mean is computed once per row and not once per member.
    """
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    df = df.withColumns({f"{p}_n": F.size(c) for p, c in members.items()})
    df = df.withColumns({f"{p}_mean": F.when(F.col(f"{p}_n") > 0, total(F.col(c)) / F.col(f"{p}_n")) for p, c in members.items()})
    out: dict[str, Column] = {}
    for p, c in members.items():
        out[f"{p}_std"] = F.when(F.col(f"{p}_n") > 0, F.sqrt(_mean_square(c, f"{p}_mean", f"{p}_n")))
        out[f"{p}_range"] = F.when(F.col(f"{p}_n") > 0, F.array_max(c) - F.array_min(c))
    return df.withColumns(out)


def _mean_square(values: str, mean: str, n: str) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - F.col(mean)) * (x - F.col(mean)))
    return squares / F.col(n)


def ensemble_rows(raw: DataFrame, as_of: Column, payload: str = "payload") -> DataFrame:
    """Ensemble payloads to rows: control values plus spread of the members.

    Members are found by key prefix, so their number is not fixed. The members' arrays are
    picked out once per payload and turned into one short array per hour before the hours
    are exploded.
    """
    keep = [c for c in raw.columns if c != payload]
    parsed = raw.select(*keep, F.from_json(payload, "struct<hourly: map<string, array<string>>>")["hourly"].alias("_h"))
    controls = {"wind_speed_kn": "wind_speed_10m", "wind_dir_deg": "wind_direction_10m", "wind_gust_kn": "wind_gusts_10m", "pressure_msl": "pressure_msl"}

    def of_variable(var: str) -> Column:
        return F.map_values(F.map_filter("_h", lambda k, _: k.startswith(var + "_member")))

    series = parsed.select(
        *keep,
        F.try_element_at("_h", F.lit("time")).alias("_time"),
        *[F.try_element_at("_h", F.lit(v)).alias(f"_c_{n}") for n, v in controls.items()],
        *[of_variable(v).alias(f"_a_{short}") for short, v in MEMBER_VARIABLES.items()],
    )

    def at_hour(time: Column, i: Column) -> Column:
        def members(short: str) -> Column:
            values = F.transform(f"_a_{short}", lambda a: F.get(a, i).try_cast("double"))
            return F.filter(values, lambda x: x.isNotNull())

        return F.struct(
            iso_time(time).alias("valid_time"),
            *[F.get(f"_c_{n}", i).try_cast("double").alias(n) for n in controls],
            *[members(short).alias(f"_m_{short}") for short in MEMBER_VARIABLES],
        )

    hours = series.select(*keep, F.inline(F.transform("_time", at_hour))).filter("valid_time IS NOT NULL")
    rows = add_member_stats(hours, {short: f"_m_{short}" for short in MEMBER_VARIABLES})
    spread = F.struct(
        F.col("speed_n").alias("n_members"),
        *[
            f"{s}_{stat}"
            for s, stats in (
                ("speed", ("mean", "std", "range")),
                ("dir", ("mean", "std", "range")),
                ("gust", ("mean", "std")),
                ("press", ("std",)),
            )
            for stat in stats
        ],
    )
    return rows.select(
        F.concat("model_name", F.lit("_ens")).alias("model_name"),
        *[c for c in keep if c != "model_name"],
        as_of.alias("run_time"),
        "valid_time",
        *controls,
        spread.alias("spread"),
    )


SPREAD_SCHEMA = (
    "struct<n_members: int, speed_mean: double, speed_std: double, speed_range: double, "
    "dir_std: double, gust_std: double, press_std: double>"
)


def spread_from_json(raw_json: Column) -> Column:
    """The seven spread fields used as features, out of the stored JSON text.

    Read as a list of one object: Spark parses the text anew for each field taken from a plain object.
    """
    return F.get(F.from_json(raw_json, f"array<{SPREAD_SCHEMA}>"), F.lit(0))
