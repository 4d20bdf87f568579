"""The wide feature row per (point, time), and its targets.

One plan builds all samples: a spine, three forecast lookups (own time, lags, pressure
anchors), one nearest-observation lookup, the climatology, then column arithmetic. All
sample-level tables are keyed by (point_id, t), so the joins share that partitioning.
Training, inference and both backtests use this plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions import decision, features as ff, timefn, wind
from sparkmos.functions.solar import add_solar
from sparkmos.operators import asof, climatology as clim, nearest, tables
from sparkmos.session import materialize
from sparkmos.settings import Point
from sparkmos.sources.payload import spread_from_json
from sparkmos.sources.points import points_df

# --- Fixed values: forecast column -> feature suffix. ---
FORECAST_FEATURES = {
    "wind_speed_kn": "speed",
    "wind_dir_deg": "dir",
    "wind_gust_kn": "gust",
    "pressure_msl": "pressure",
    "temperature_2m": "temp",
    "dew_point_2m": "dewpt",
    "cloud_cover": "cloud",
    "shortwave_radiation": "rad",
    "cape": "cape",
    "boundary_layer_height": "blh",
    "precipitation": "precip",
    "weather_code": "weather_code",
    "visibility": "visibility",
}
LEVEL_FEATURES = {
    "wind_speed_80m": "speed_80m",
    "wind_direction_80m": "dir_80m",
    "wind_speed_120m": "speed_120m",
    "wind_direction_120m": "dir_120m",
}
UPPER_FEATURES = [
    "wind_speed_850hPa", "wind_direction_850hPa", "temperature_850hPa",
    "geopotential_height_500hPa", "wind_speed_500hPa", "wind_direction_500hPa",
]
SPREAD_FEATURES = {
    "n_members": "n_members", "speed_mean": "speed_mean", "speed_std": "speed_std", "speed_range": "speed_range",
    "dir_std": "dir_std", "gust_std": "gust_std", "press_std": "press_std",
}
# --- End of fixed values. ---

REF = cfg.REFERENCE_MODEL
LAG_COLUMNS = ["wind_speed_kn", "wind_dir_deg", "pressure_msl", "temperature_2m", "shortwave_radiation"]


def forecast_features(
    samples: DataFrame,
    forecasts: DataFrame,
    *,
    models: Sequence[str] = cfg.MODELS,
    ensembles: Sequence[str] = (),
    reference: str = REF,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Own-time forecasts of every configured model as columns; needs the reference model.

    A model without a forecast gives NULL columns. ``n_models`` counts configured
    deterministic models, ``n_rows`` everything found, ensembles included.
    """
    have = set(forecasts.columns)
    wanted = {**FORECAST_FEATURES, **{c: n for c, n in LEVEL_FEATURES.items() if c in have}}
    upper = [c for c in UPPER_FEATURES if c in have]
    extra = ["raw_json"] if ensembles else []
    found = asof.forecasts_at(samples, forecasts, [*wanted, *upper, *extra], 30, tie_break=tie_break)


    def of_model(column: str, model: str, name: str) -> Column:
        return F.expr(f"max({column}) FILTER (WHERE model_name = '{model}')").alias(name)

    aggs = [
        F.count(F.when(F.col("model_name").isin(*models), 1)).alias("n_models"),
        F.count("*").alias("n_rows"),
        F.expr(f"count_if(model_name = '{reference}')").alias("_has_ref"),
    ]
    for m in models:
        aggs += [of_model(c, m, f"fc_{m}_{name}") for c, name in wanted.items()]
    aggs += [of_model("raw_json", f"{e}_ens", f"_ens_{e}") for e in ensembles]
    aggs += [of_model(c, reference, f"ua_{c}") for c in upper]
    wide = found.groupBy("point_id", "t").agg(*aggs).filter("_has_ref > 0").drop("_has_ref")
    more: dict[str, Column] = {}
    for m in models:
        s, d = f"fc_{m}_speed", f"fc_{m}_dir"
        more[f"fc_{m}_u"] = F.expr(f"-{s} * sin(radians({d}))")
        more[f"fc_{m}_v"] = F.expr(f"-{s} * cos(radians({d}))")
        for level in ("80", "120"):
            if f"wind_speed_{level}m" in wanted:
                more[f"fc_{m}_shear_10_{level}"] = ff.shear(F.col(f"fc_{m}_speed_{level}m"), F.col(s))
    if "wind_speed_850hPa" in upper:
        more["ua_shear_10_850"] = ff.shear(F.col("ua_wind_speed_850hPa"), F.col(f"fc_{reference}_speed"))
    if "temperature_850hPa" in upper:
        more["ua_thermal_advection"] = F.col("ua_temperature_850hPa") - F.col(f"fc_{reference}_temp")
    wide = wide.withColumns({**more, **ff.agreement(models)})
    for e in ensembles:
        spread = spread_from_json(F.col(f"_ens_{e}"))
        wide = wide.withColumns({f"ens_{e}_{n}": spread[c] for c, n in SPREAD_FEATURES.items()}).drop(f"_ens_{e}")
    return wide


def newest_forecasts(forecasts: DataFrame, ensembles: Sequence[str] = (), tie_break: Sequence[str] = ()) -> DataFrame:
    """The forecasts that any look-up can find, with the columns any of them reads, written once."""
    read = [*FORECAST_FEATURES, *LEVEL_FEATURES, *UPPER_FEATURES, *(["raw_json"] if ensembles else [])]
    have = set(forecasts.columns)
    return materialize(asof.newest_runs(forecasts, [c for c in read if c in have], tie_break).drop("v_min", "bucket"))


def anchor_pressures(times: DataFrame, forecasts: DataFrame, *, window: int = 180, tie_break: Sequence[str] = ()) -> DataFrame:
    """Per distinct ``t`` the pressure at each anchor: the first model by name that has one."""
    anchors = list(cfg.ANCHORS.values())
    requests = times.select("t").distinct().withColumn("point_id", F.explode(F.array(*[F.lit(a) for a in anchors])))
    near = forecasts.filter(F.col("point_id").isin(*anchors))
    found = asof.forecasts_at(requests, near, ["pressure_msl"], window, tie_break=tie_break)
    first = F.min_by("pressure_msl", F.when(F.col("pressure_msl").isNotNull(), F.col("model_name")))
    per_anchor = found.groupBy("point_id", "t").agg(first.alias("p"))
    return per_anchor.groupBy("t").agg(
        *[F.max(F.when(F.col("point_id") == pid, F.col("p"))).alias(f"p_{name}") for name, pid in cfg.ANCHORS.items()]
    )


def lagged_forecasts(
    samples: DataFrame, forecasts: DataFrame, *, reference: str = REF, causal: bool = True, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Reference forecasts before each sample: hourly for heat and sun, 15/60/240 min for trends.

    Samples of a point share most of these times (an hour ago for one is now for another),
    so each distinct (point, time) is looked up once, and the result is handed forward to
    every sample it serves. ``causal`` ignores valid times after the wanted time.
    """
    hours = [h * 60 for h in range(cfg.THERMAL_HOURS)]
    offsets = sorted({*hours, *cfg.LAG_MINUTES})
    back = F.explode(F.array(*[F.lit(o) for o in offsets]))
    lookups = (
        samples.select("point_id", "t", back.alias("off"))
        .select("point_id", (F.col("t") - F.make_dt_interval(mins=F.col("off"))).alias("t"))
        .distinct()
    )
    found = asof.reference_forecast(
        lookups, forecasts, LAG_COLUMNS, 120, reference, causal=causal, tie_break=tie_break
    )
    served = found.select("point_id", F.col("t").alias("at"), *LAG_COLUMNS, back.alias("off")).withColumn(
        "t", F.col("at") + F.make_dt_interval(mins=F.col("off"))
    )
    off, temp, rad = F.col("off"), F.col("temperature_2m"), F.col("shortwave_radiation")
    hourly = off.isin(*hours)
    warm = F.when(hourly & temp.isNotNull(), off)
    aggs = [
        F.avg(F.when(hourly, temp)).alias("ti_mean"),
        F.count(F.when(hourly, temp)).alias("ti_n"),
        F.min_by("temperature_2m", warm).alias("ti_newest"),
        F.max_by("temperature_2m", warm).alias("ti_oldest"),
        F.sum(F.when(hourly, rad)).alias("ti_solar"),
        F.sum(F.when(hourly & (off < cfg.SOLAR_HOURS * 60), rad)).alias("solar_3h"),
    ]
    for lag in cfg.LAG_MINUTES:
        for c, name in (("wind_speed_kn", "speed"), ("wind_dir_deg", "dir"), ("pressure_msl", "press"), ("temperature_2m", "temp")):
            aggs.append(F.expr(f"max({c}) FILTER (WHERE off = {lag})").alias(f"lag{lag}_{name}"))
    return served.groupBy("point_id", "t").agg(*aggs)


def lag_derivatives(current_speed: Column) -> dict[str, Column]:
    return {f"lag{m}_speed_dt": (current_speed - F.col(f"lag{m}_speed")) / (m / 60.0) for m in cfg.LAG_MINUTES}


def climatology_features(
    samples: DataFrame, speeds: DataFrame, climatology: DataFrame, years_back: int = clim.YEARS_BACK, store: bool = False
) -> DataFrame:
    """Normals, frequency and percentile per sample (point_id, t); ``speeds`` adds ``fc_speed``.

    With ``store`` the hourly sums of the history are written once; without it the history is
    summed anew wherever they are used.
    """
    hourly = clim.hourly_partials(climatology)
    if store:
        hourly = materialize(hourly)
    n = clim.normals(samples, climatology, years_back=years_back, hourly=hourly)
    pct = clim.seasonal_percentile(speeds, climatology, years_back=years_back, times=samples)
    foehn = clim.foehn_frequency(samples, climatology, years_back=years_back, hourly=hourly)
    return n.join(pct, ["point_id", "t"], "left").join(foehn.drop("n_north_days"), "t", "left")


def anomalies() -> dict[str, Column]:
    return {
        "wind_speed_anomaly": F.col(f"fc_{REF}_speed") - F.col("climatology_wind_speed_normal"),
        "temp_anomaly": F.col(f"fc_{REF}_temp") - F.col("climatology_temp_normal"),
        "pressure_anomaly": F.col(f"fc_{REF}_pressure") - F.col("climatology_pressure_normal"),
    }


def observation_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "point_id",
        "t",
        F.col("wind_speed_kn").alias("obs_nearest_speed"),
        F.col("wind_dir_deg").alias("obs_nearest_dir"),
        F.col("wind_gust_kn").alias("obs_nearest_gust"),
        F.col("dist_km").alias("obs_nearest_dist_km"),
        F.col("age_min").alias("obs_nearest_age_min"),
        F.col("source").alias("obs_source"),
    )


def targets(reference: str = REF) -> dict[str, Column]:
    """Observed minus forecast wind; NULL unless all four values are there."""
    s, d = F.col(f"fc_{reference}_speed"), F.col(f"fc_{reference}_dir")
    os, od = F.col("obs_nearest_speed"), F.col("obs_nearest_dir")
    return {"target_u": wind.u_of(os, od) - wind.u_of(s, d), "target_v": wind.v_of(os, od) - wind.v_of(s, d)}


def build_features(
    samples: DataFrame,
    forecasts: DataFrame,
    observations: DataFrame,
    points: Sequence[Point] = cfg.POINTS,
    *,
    climatology: DataFrame | None = None,
    ensembles: Sequence[str] = (),
    reference: str = REF,
    lookback_min: int = 60,
    exclude_min: int = 0,
    causal: bool = True,
    years_back: int = clim.YEARS_BACK,
    start: Column | None = None,
    end: Column | None = None,
    tie_break: Sequence[str] = (),
    store: bool = False,
) -> DataFrame:
    """Features and targets for every (point_id, t) that has a reference forecast.

    The scans of the stored tables read only the days the look-ups can reach. ``start`` and
    ``end`` bound the samples' times; without them the bounds are taken from the samples.

    ``exclude_min`` keeps the newest observations out of the lookup; by default the
    observation used as feature may be the one the target is made of.

    ``store`` writes what several look-ups share to the scratch folder first, as jobs of their
    own, so that they read the tables once instead of once each: worth it for training and
    backtests over long histories.
    """
    keys = ["point_id", "t"]
    spark = samples.sparkSession
    base = samples.select(*keys).distinct()
    if start is None or end is None:
        start, end = tables.span_of(base, "t")
    forecasts = tables.in_range(forecasts, "valid_time", start, end, "INTERVAL '8' HOUR", "INTERVAL '4' HOUR")
    observations = tables.in_range(observations, "timestamp", start, end, "INTERVAL '73' HOUR")
    if climatology is not None:
        climatology = tables.in_range(climatology, "timestamp", start, None, f"INTERVAL '{365 * years_back + 1}' DAY")
    if store:
        forecasts = newest_forecasts(forecasts, ensembles, tie_break)
    own = forecast_features(base, forecasts, ensembles=ensembles, reference=reference, tie_break=tie_break)
    lags = lagged_forecasts(base, forecasts, reference=reference, causal=causal, tie_break=tie_break)
    obs = observation_columns(
        nearest.nearest_observation(
            base, observations, points, max_age_min=lookback_min, min_age_min=exclude_min, tie_break=tie_break
        )
    )
    water = nearest.newest_value(
        base, observations.filter("source = 'lake_water_temp'"), "temperature", max_age_hours=72, tie_break=tie_break
    ).withColumnRenamed("temperature", "water_temp")
    pressure = anchor_pressures(base, forecasts, tie_break=tie_break)
    df = own.join(lags, keys, "left").join(obs, keys, "left")
    if climatology is not None:
        # Looked up again for the reference model alone: one column of one model is far less
        # than the wide table, which would otherwise be built twice.
        one = forecasts.filter(F.col("model_name") == reference)
        speeds = asof.forecasts_at(base, one, ["wind_speed_kn"], 30, tie_break=tie_break)
        speeds = speeds.select(*keys, F.col("wind_speed_kn").alias("fc_speed"))
        df = df.join(climatology_features(base, speeds, climatology, years_back, store), keys, "left")
    df = df.join(pressure, "t", "left").join(water, "t", "left")
    # The sun's two dozen steps are planned over three columns, not over the wide row.
    places = points_df(spark, points).select("point_id", "lat", "lon")
    df = df.join(add_solar(base.join(places, "point_id"), time="t").drop("lat", "lon"), keys)

    local_time = timefn.local("t")
    anchor = {name: F.col(f"p_{name}") for name in cfg.ANCHORS}
    gradient = anchor["zurich"] - anchor["milano"]
    r = lambda f: F.col(f"fc_{reference}_{f}")
    df = df.withColumns(
        {
            **timefn.window_flags(local_time),
            **timefn.calendar(local_time),
            **ff.foehn_flags(gradient),
            **ff.pressure_gradients(anchor),
            **ff.thermal_inertia(F.col("ti_mean"), F.col("ti_newest"), F.col("ti_oldest"), F.col("ti_n"), F.col("ti_solar")),
            **ff.stability(r("cape"), r("blh"), r("speed"), r("gust"), r("temp"), r("dewpt"), F.col("solar_is_daytime")),
            **ff.lake_breeze(
                r("temp"), F.col("water_temp"), F.col("solar_3h"),
                F.coalesce(F.col(f"fc_{cfg.SYNOPTIC_MODEL}_speed"), r("speed")), F.hour(local_time),
            ),
            **lag_derivatives(r("speed")),
            "obs_nearest_missing": F.col("obs_nearest_dist_km").isNull(),
            "obs_nearest_confidence": decision.observation_confidence(
                F.col("obs_nearest_dist_km"), F.col("obs_nearest_age_min")
            ),
            **targets(reference),
        }
    )
    df = df.withColumns(
        ff.foehn_strength(
            F.coalesce("pressure_grad_zurich_milano", "foehn_pressure_gradient"), r("temp"), r("dewpt"), r("dir")
        )
    )
    if climatology is not None:
        df = df.withColumns(anomalies())
    drop = ["ti_mean", "ti_n", "ti_newest", "ti_oldest", "ti_solar", "solar_3h", "water_temp"]
    df = df.drop(*drop, *[f"p_{name}" for name in cfg.ANCHORS]).withColumns(
        {"ref_speed_kn": F.coalesce(r("speed"), F.lit(0.0)), "ref_dir_deg": F.coalesce(r("dir"), F.lit(0.0))}
    )
    return df.withColumnRenamed("t", "valid_time")


META = [
    "point_id", "valid_time", "n_models", "n_rows", "obs_source", "ref_speed_kn", "ref_dir_deg", "target_u", "target_v",
]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META]


def training_set(features: DataFrame) -> DataFrame:
    return features.filter("target_u IS NOT NULL AND target_v IS NOT NULL")


def stored_features(features: DataFrame, version: str = "v1") -> DataFrame:
    """Rows for the ``features`` table: the vector as JSON text beside its targets."""
    cols = feature_columns(features)
    return features.select(
        F.xxhash64("point_id", "valid_time", F.lit(version)).alias("id"),
        "point_id",
        "valid_time",
        F.lit(version).alias("feature_set_version"),
        F.to_json(F.struct(*cols)).alias("feature_vector"),
        "target_u",
        "target_v",
    )


def group_counts(columns: Sequence[str], df: DataFrame) -> DataFrame:
    """Non-NULL feature values per feature group, over all rows."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in columns])
    return counts.select(F.inline(entries)).groupBy(decision.feature_group(F.col("name")).alias("feature_group")).agg(
        F.count("*").alias("n_features"), F.sum("n").alias("n_values")
    )


__all__ = ["build_features", "feature_columns", "training_set"]
