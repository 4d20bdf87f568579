"""D1-D3 and the feature formulas F23-F31, F44-F46."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from checks.aggregates import TIMES
from checks.fx import END, START, YEARS_BACK, as_of, doubles, query, r, sql, table
from checks.ingest import S4, ensemble_payloads, payloads
from checks.lookups import OP_SPINE, REF, SPINE, TB, full_spine, lookup_sql, nearest_sql
from checks.scalars import HA, U, V, stage
from sparkmos import settings as cfg
from sparkmos.functions import features as ff
from sparkmos.functions.common import ts
from sparkmos.plans import features, spine
from sparkmos.sources import payload

FX = ("fx_points", "fx_forecast_runs", "fx_observations", "fx_climatology")
FIELDS = features.FORECAST_FEATURES
MODELS = cfg.MODELS
REFM = cfg.REFERENCE_MODEL


@query("d01_hourly_spine", sql(f"WITH {OP_SPINE}, w AS (SELECT point_id, count(*) AS n FROM fx_forecast_runs GROUP BY 1) SELECT s.point_id, t, n FROM spine s JOIN w USING (point_id) WHERE hour(t) % 3 = 0", "fx_forecast_runs"))
def d01(spark, sf):
    """Three-hourly samples of each operational point, with the forecasts it can draw on."""
    p = table(spark, sf, "fx_points").filter("is_operational")
    n = table(spark, sf, "fx_forecast_runs").groupBy("point_id").agg(F.count("*").alias("n"))
    return spine.hourly_spine(p, ts(START), ts(END), 3).join(n, "point_id").select("point_id", "t", "n")


def features_df(spark, sf, climatology=True, operational=True):
    t = lambda n: table(spark, sf, n)
    return features.build_features(
        full_spine(spark, sf, operational), t("fx_forecast_runs"), t("fx_observations"), cfg.OPERATIONAL if operational else cfg.POINTS,
        climatology=t("fx_climatology") if climatology else None, years_back=YEARS_BACK, start=ts(START), end=ts(END), tie_break=TB, store=True,
    )


def ang(a: str, b: str) -> str:
    return f"CASE WHEN abs({a} - {b}) > 180 THEN 360 - abs({a} - {b}) ELSE abs({a} - {b}) END"


WIDE = "wide AS (SELECT point_id, t, count(*) AS n_models, {cols} FROM own GROUP BY ALL HAVING count(*) FILTER (WHERE model_name = '{ref}') > 0)".format(
    cols=", ".join(f"max({c}) FILTER (WHERE model_name = '{m}') AS fc_{m}_{n}" for m in MODELS for c, n in FIELDS.items()), ref=REFM)
OWN = f"{lookup_sql(30, name='own')}, {WIDE}"
FC_COLS = [f"fc_{m}_{n}" for m in MODELS for n in FIELDS.values() if n != "weather_code"]
AGREE = {}
for a, b in combinations(MODELS, 2):
    for f_, s_ in (("speed", "speed"), ("pressure", "press"), ("temp", "temp")):
        AGREE[f"agree_{s_}_{a}_{b}"] = f"abs(fc_{a}_{f_} - fc_{b}_{f_})"
    AGREE[f"agree_dir_{a}_{b}"] = ang(f"fc_{a}_dir", f"fc_{b}_dir")
UVS = {f"fc_{m}_{x}": e.format(s=f"fc_{m}_speed", d=f"fc_{m}_dir") for m in MODELS for x, e in (("u", U), ("v", V))}

D2_FORECAST = sql(f"""WITH {OP_SPINE}, {OWN} SELECT point_id, t AS valid_time, n_models, {doubles(' '.join(FC_COLS))},
{', '.join(f'CAST(fc_{m}_weather_code AS DOUBLE) AS fc_{m}_weather_code' for m in MODELS)}, {', '.join(f'{r(e)} AS {n}' for n, e in {**UVS, **AGREE}.items())} FROM wide""", *FX)


@query("d02_features_forecast", D2_FORECAST)
def d02_forecast(spark, sf):
    f = features.forecast_features(full_spine(spark, sf, True), table(spark, sf, "fx_forecast_runs"), tie_break=TB)
    codes = {f"fc_{m}_weather_code": F.col(f"fc_{m}_weather_code").cast("double") for m in MODELS}
    return f.drop("n_rows").withColumns(codes).withColumnRenamed("t", "valid_time")


LAGGED = f"""offs AS (SELECT unnest([0, 15, 60, 120, 180, 240, 300]) AS off),
lagged AS (SELECT DISTINCT point_id, t - off * INTERVAL '1' MINUTE AS t FROM spine CROSS JOIN offs), {lookup_sql(120, 'lagged', True)}, {REF},
hist AS (SELECT s.point_id, s.t, off, ref.* EXCLUDE (point_id, t) FROM spine s CROSS JOIN offs JOIN ref ON ref.point_id = s.point_id AND ref.t = s.t - off * INTERVAL '1' MINUTE),
lags AS (SELECT point_id, t, avg(temperature_2m) FILTER (WHERE off <> 15) AS m, count(temperature_2m) FILTER (WHERE off <> 15) AS nt,
  arg_min(temperature_2m, off) FILTER (WHERE off <> 15) AS tn, arg_max(temperature_2m, off) FILTER (WHERE off <> 15) AS told,
  sum(shortwave_radiation) FILTER (WHERE off <> 15) AS so, sum(shortwave_radiation) FILTER (WHERE off IN (0, 60, 120)) AS s3,
  {', '.join(f"max({c}) FILTER (WHERE off = {m}) AS lag{m}_{n}" for m in cfg.LAG_MINUTES for c, n in (('wind_speed_kn', 'speed'), ('wind_dir_deg', 'dir'), ('pressure_msl', 'press'), ('temperature_2m', 'temp')))}
  FROM hist GROUP BY ALL)"""
ANCHORS = f"""anch AS (SELECT p.point_id, t FROM fx_points p CROSS JOIN times WHERE p.point_id IN ({', '.join(repr(v) for v in cfg.ANCHORS.values())})), {lookup_sql(180, 'anch', name='afound')},
ap AS (SELECT point_id, t, arg_min(pressure_msl, model_name) FILTER (WHERE pressure_msl IS NOT NULL) AS p FROM afound GROUP BY ALL),
anchor AS (SELECT t, {', '.join(f"max(p) FILTER (WHERE point_id = '{v}') AS p_{k}" for k, v in cfg.ANCHORS.items())} FROM ap GROUP BY 1)"""
WATER = """water AS (SELECT t, arg_max(temperature, (timestamp, id)) AS water FROM times JOIN fx_observations o ON source = 'lake_water_temp' AND temperature IS NOT NULL
  AND timestamp <= t AND timestamp >= t - INTERVAL '72' HOUR GROUP BY 1)"""
SUN = f"""base2 AS (SELECT point_id, lat, lon, t, epoch(t) / 60 AS em, epoch_ms(CAST(t AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome' AS DATE)) / 86400000 AS dn FROM spine),
{stage('dd', 'base2', 'dn + 2440587.5 + 0.5')},
rs AS (SELECT *, 720 - 4 * lon - dd_q - 4 * {HA.format(d='dd_d')} AS rise0, 720 - 4 * lon - dd_q + 4 * {HA.format(d='dd_d')} AS set0 FROM dd),
{stage('ri', 'rs', 'dn + 2440587.5 + rise0 / 1440')}, {stage('se', 'ri', 'dn + 2440587.5 + set0 / 1440')},
sun AS (SELECT point_id, t, em - dn * 1440 >= 720 - 4 * (lon + {HA.format(d='ri_d')}) - ri_q AND em - dn * 1440 <= 720 - 4 * (lon - {HA.format(d='se_d')}) - se_q AS is_day FROM se)"""



def clamp(x: str, lo: float, hi: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest({lo}, least({hi}, {x})) END"


def ref(n: str) -> str:
    return f"fc_{REFM}_{n}"


SCORE = f"coalesce({clamp(f'0.5 + {ref('cape')} / 2000', 0, 1)}, {clamp('(' + ref('blh') + ' - 500) / 1500', 0, 1)}, 0.5)"
OFFN = f"least({ref('dir')}, 360 - {ref('dir')})"
NORTH = f"CASE WHEN {ref('dir')} IS NOT NULL THEN CASE WHEN {OFFN} <= 45 THEN 1 - {OFFN} / 45 * 0.3 ELSE 0 END END"
PGS, DRY = clamp("pressure_grad_zurich_milano / 12", 0, 1), clamp(f"({ref('temp')} - {ref('dewpt')}) / 15", 0, 1)
SUPP = clamp(f"1 - (coalesce(fc_{cfg.SYNOPTIC_MODEL}_speed, {ref('speed')}) - 3) / 12", 0, 1)
TF = "CASE WHEN lh BETWEEN 9 AND 19 THEN greatest(0, 1 - abs(lh - 14) / 5.0::DOUBLE) ELSE 0 END"
LCL = "strftime(lt, '%H:%M')"
CONTEXT = {
    "foehn_pressure_gradient": "p_zurich - p_milano",
    **{f"pressure_grad_{n}": (f"p_{a} - p_{b}", 2) for n, (a, b) in cfg.ANCHOR_GRADIENTS.items() if n != "zurich_milano"},
    "pressure_grad_zurich_milano": "pressure_grad_zurich_milano",
    "thermal_inertia_avg_temp": ("m", 2),
    "thermal_inertia_temp_trend": ("(tn - told) / greatest(nt - 1, 1)", 4),
    "thermal_inertia_solar_accum": ("CASE WHEN m IS NOT NULL THEN coalesce(so, 0) END", 1),
    "thermal_inertia_index": ("CASE WHEN m IS NOT NULL THEN 0.5 * least(1, coalesce(so, 0) / 3000) + 0.2 * greatest(0, least(1, ((tn - told) / greatest(nt - 1, 1) + 2) / 4)) + 0.3 * greatest(0, least(1, (m - 5) / 30)) END", 4),
    "cape_instability_proxy": (f"-{ref('cape')} / 100", 2),
    "surface_shear_proxy": (f"CASE WHEN {ref('gust')} - {ref('speed')} > 0.1 THEN {ref('cape')} / (0.5 * pow({ref('gust')} - {ref('speed')}, 2)) END", 2),
    "stability_score": (SCORE, 4),
    "stability_convective_potential": f"CASE WHEN {ref('cape')} > 1000 AND {SCORE} > 0.6 AND is_day THEN 1 ELSE 0 END",
    "temp_dewpt_spread": (f"{ref('temp')} - {ref('dewpt')}", 2),
    "lake_breeze_air_water_delta": (f"{ref('temp')} - water", 2),
    "lake_breeze_solar_3h": ("s3", 1),
    "lake_breeze_synoptic_suppression": (SUPP, 4),
    "lake_breeze_time_factor": (TF, 4),
    "lake_breeze_potential": (f"CASE WHEN s3 IS NOT NULL THEN 0.35 * {clamp(f'({ref('temp')} - water) / 8', 0, 1)} + 0.25 * least(1, s3 / 1500) + 0.2 * {SUPP} + 0.2 * {TF} END", 4),
    "foehn_pg_score": (PGS, 4),
    "foehn_dewpoint_depression": (f"{ref('temp')} - {ref('dewpt')}", 2),
    "foehn_dewpt_score": (DRY, 4),
    "foehn_dir_score": (NORTH, 4),
    "foehn_strength_index": (f"(SELECT CASE WHEN count(x) >= 2 THEN avg(x) END FROM (VALUES ({PGS}), ({DRY}), ({NORTH})) q(x))", 4),
    **{f"lag{m}_{n}": f"lag{m}_{n}" for m in cfg.LAG_MINUTES for n in ("speed", "dir", "press", "temp")},
    **{f"lag{m}_speed_dt": f"({ref('speed')} - lag{m}_speed) / ({m} / 60.0::DOUBLE)" for m in cfg.LAG_MINUTES},
    "obs_nearest_speed": "o_speed", "obs_nearest_dir": "o_dir", "obs_nearest_gust": "o_gust", "obs_nearest_dist_km": "dist_km", "obs_nearest_age_min": "age_min",
    "obs_nearest_confidence": "CASE WHEN dist_km IS NULL THEN 0 ELSE 1 / (1 + dist_km / 5 + greatest(0, age_min) / 30) END",
    "target_u": f"{U.format(s='o_speed', d='o_dir')} - ({U.format(s=ref('speed'), d=ref('dir'))})",
    "target_v": f"{V.format(s='o_speed', d='o_dir')} - ({V.format(s=ref('speed'), d=ref('dir'))})",
    "ref_speed_kn": f"coalesce({ref('speed')}, 0)", "ref_dir_deg": f"coalesce({ref('dir')}, 0)",
}
FLAGS = {
    "foehn_likely": "coalesce(p_zurich - p_milano >= 8, FALSE)", "foehn_strong": "coalesce(p_zurich - p_milano >= 12, FALSE)",
    "tivano_dying": f"{LCL} BETWEEN '08:30' AND '09:30'", "breva_building": f"{LCL} BETWEEN '10:30' AND '11:00'",
    "breva_window": f"{LCL} BETWEEN '10:00' AND '18:00'", "tivano_window": f"{LCL} BETWEEN '04:00' AND '09:30'",
    "hour_local": "lh", "day_of_year": "dayofyear(lt)", "month": "month(lt)", "season": "CAST(0 AS BIGINT)", "is_weekend": "isodow(lt) >= 6",
    "solar_is_daytime": "is_day", "obs_nearest_missing": "dist_km IS NULL", "obs_source": "o_source",
}
JOINED = f"""{OP_SPINE}, {TIMES}, {OWN}, {LAGGED}, {ANCHORS}, {WATER}, {SUN}, {nearest_sql(0, 60)},
j0 AS (SELECT w.*, l.* EXCLUDE (point_id, t), a.* EXCLUDE (t), water, is_day, near.wind_speed_kn AS o_speed, near.wind_dir_deg AS o_dir, near.wind_gust_kn AS o_gust, dist_km, age_min, near.source AS o_source,
  w.t AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome' AS lt, hour(w.t AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome') AS lh, {r('p_zurich - p_milano', 2)} AS pressure_grad_zurich_milano
  FROM wide w LEFT JOIN lags l USING (point_id, t) LEFT JOIN anchor a USING (t) LEFT JOIN water USING (t) LEFT JOIN near USING (point_id, t) LEFT JOIN sun USING (point_id, t))"""


def col_sql(e) -> str:
    return r(r(e[0], e[1])) if isinstance(e, tuple) else r(e)


D2_CONTEXT = sql(f"""WITH {JOINED} SELECT point_id, t AS valid_time, {', '.join(f'{col_sql(e)} AS {n}' for n, e in CONTEXT.items())}, {', '.join(f'{e} AS {n}' for n, e in FLAGS.items())} FROM j0""", *FX)


@query("d02_features_context", D2_CONTEXT)
def d02_context(spark, sf):
    return features_df(spark, sf, climatology=False).select("point_id", "valid_time", *CONTEXT, *FLAGS)


CUT = f"INTERVAL '{365 * YEARS_BACK}' DAY"
D2_CLIM = sql(f"""WITH {OP_SPINE}, {OWN}, n AS (SELECT s.point_id, s.t, avg(wind_speed_10m) AS ws, avg(temperature_2m) AS te, avg(pressure_msl) AS pr,
  count(*) FILTER (WHERE wind_speed_10m < fc_{REFM}_speed) * 100.0::DOUBLE / count(*) AS pct, count(c.point_id) AS nc
  FROM wide s LEFT JOIN fx_climatology c ON s.point_id = c.point_id AND dayofyear(c.timestamp) BETWEEN greatest(1, dayofyear(s.t) - 15) AND least(366, dayofyear(s.t) + 15) AND c.timestamp >= s.t - {CUT} GROUP BY ALL)
SELECT w.point_id, w.t AS valid_time, {r('ws')} AS climatology_wind_speed_normal, {r(f'fc_{REFM}_speed - ws')} AS wind_speed_anomaly, {r(f'fc_{REFM}_temp - te')} AS temp_anomaly, {r(f'fc_{REFM}_pressure - pr')} AS pressure_anomaly,
  CASE WHEN nc > 0 THEN {r('pct', 1)} END AS seasonal_wind_percentile FROM wide w JOIN n USING (point_id, t)""", *FX)


@query("d02_features_climatology", D2_CLIM)
def d02_clim(spark, sf):
    return features_df(spark, sf).select(
        "point_id", "valid_time", "climatology_wind_speed_normal", "wind_speed_anomaly", "temp_anomaly", "pressure_anomaly", "seasonal_wind_percentile"
    )


@query("d03_training_set", sql(f"""WITH {OP_SPINE}, {OWN}, {nearest_sql(0, 60)} SELECT w.point_id, count(*) AS n, {r(f"avg({CONTEXT['target_u'].replace('o_speed', 'near.wind_speed_kn').replace('o_dir', 'near.wind_dir_deg')})")} AS mean_target_u
FROM wide w JOIN near USING (point_id, t) WHERE {ref('speed')} IS NOT NULL AND {ref('dir')} IS NOT NULL GROUP BY 1""", *FX))
def d03(spark, sf):
    return features.training_set(features_df(spark, sf)).groupBy("point_id").agg(
        F.count("*").alias("n"), F.avg("target_u").alias("mean_target_u")
    )


# --- Formulas on their own, over forecast rows. ---

FC = "fx_forecast_runs"


@query("f23_agreement", sql(f"WITH {SPINE}, {OWN} SELECT point_id, t, {', '.join(f'{r(AGREE[n])} AS {n}' for n in list(AGREE)[:8])} FROM wide", *FX))
def f23(spark, sf):
    f = features.forecast_features(full_spine(spark, sf), table(spark, sf, FC), tie_break=TB)
    return f.select("point_id", "t", *list(AGREE)[:8])


@query("f24_foehn_flags", sql(f"SELECT id, {r('pressure_msl - 1015')} AS foehn_pressure_gradient, coalesce(pressure_msl - 1015 >= 8, FALSE) AS foehn_likely, coalesce(pressure_msl - 1015 >= 12, FALSE) AS foehn_strong FROM fx_forecast_runs", FC))
def f24(spark, sf):
    return table(spark, sf, FC).select("id", *[c.alias(n) for n, c in ff.foehn_flags(F.col("pressure_msl") - 1015).items()])


@query("f25_anchor_gradients", sql(f"WITH {TIMES}, {ANCHORS} SELECT t, {', '.join(f'{r(f'p_{a} - p_{b}', 2)} AS pressure_grad_{n}' for n, (a, b) in cfg.ANCHOR_GRADIENTS.items())} FROM anchor", "fx_points", FC))
def f25(spark, sf):
    p = features.anchor_pressures(full_spine(spark, sf), table(spark, sf, FC), tie_break=TB)
    return p.select("t", *[c.alias(n) for n, c in ff.pressure_gradients({k: F.col(f"p_{k}") for k in cfg.ANCHORS}).items()])


C26 = "CASE WHEN id % 5 <> 0 THEN cape END"
S26 = f"CASE WHEN ({C26}) IS NOT NULL THEN greatest(0, least(1, 0.5 + ({C26}) / 2000)) ELSE greatest(0, least(1, (boundary_layer_height - 500) / 1500)) END"


@query("f26_stability", sql(f"""SELECT id, {r(f'-({C26}) / 100', 2)} AS cape_instability_proxy, {r(f'CASE WHEN wind_gust_kn - wind_speed_kn > 0.1 THEN ({C26}) / (0.5 * pow(wind_gust_kn - wind_speed_kn, 2)) END', 2)} AS surface_shear_proxy,
  {r(S26, 4)} AS stability_score, CAST(CASE WHEN ({C26}) > 1000 AND {S26} > 0.6 AND id % 3 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS stability_convective_potential, {r('temperature_2m - dew_point_2m', 2)} AS temp_dewpt_spread FROM fx_forecast_runs""", FC))
def f26(spark, sf):
    cape = F.when(F.col("id") % 5 != 0, F.col("cape"))
    s = ff.stability(cape, F.col("boundary_layer_height"), F.col("wind_speed_kn"), F.col("wind_gust_kn"), F.col("temperature_2m"), F.col("dew_point_2m"), F.col("id") % 3 == 0)
    return table(spark, sf, FC).select("id", *[c.alias(n) for n, c in s.items()])


SUP27 = clamp("1 - (wind_speed_kn - 3) / 12", 0, 1)
TF27 = "CASE WHEN hour(valid_time) BETWEEN 9 AND 19 THEN greatest(0, 1 - abs(hour(valid_time) - 14) / 5.0::DOUBLE) ELSE 0 END"


@query("f27_lake_breeze", sql(f"""SELECT id, {r('temperature_2m - dew_point_2m', 2)} AS lake_breeze_air_water_delta, {r('shortwave_radiation * 3', 1)} AS lake_breeze_solar_3h, {r(SUP27, 4)} AS lake_breeze_synoptic_suppression, {r(TF27, 4)} AS lake_breeze_time_factor,
  {r(f'0.35 * greatest(0, least(1, (temperature_2m - dew_point_2m) / 8)) + 0.25 * least(1, shortwave_radiation * 3 / 1500) + 0.2 * {SUP27} + 0.2 * {TF27}', 4)} AS lake_breeze_potential FROM fx_forecast_runs""", FC))
def f27(spark, sf):
    lb = ff.lake_breeze(F.col("temperature_2m"), F.col("dew_point_2m"), F.col("shortwave_radiation") * 3, F.col("wind_speed_kn"), F.hour("valid_time"))
    return table(spark, sf, FC).select("id", *[c.alias(n) for n, c in lb.items()])


OFF28 = "least(wind_dir_deg, 360 - wind_dir_deg)"
N28 = f"CASE WHEN wind_dir_deg IS NOT NULL THEN CASE WHEN {OFF28} <= 45 THEN 1 - {OFF28} / 45 * 0.3 ELSE 0 END END"
P28, D28 = clamp("(pressure_msl - 1010) / 12", 0, 1), clamp("(temperature_2m - dew_point_2m) / 15", 0, 1)


@query("f28_foehn_strength", sql(f"""SELECT id, {r(P28, 4)} AS foehn_pg_score, {r('temperature_2m - dew_point_2m', 2)} AS foehn_dewpoint_depression, {r(D28, 4)} AS foehn_dewpt_score, {r(N28, 4)} AS foehn_dir_score,
  {r(f'(SELECT CASE WHEN count(x) >= 2 THEN avg(x) END FROM (VALUES ({P28}), ({D28}), ({N28})) q(x))', 4)} AS foehn_strength_index FROM fx_forecast_runs""", FC))
def f28(spark, sf):
    s = ff.foehn_strength(F.col("pressure_msl") - 1010, F.col("temperature_2m"), F.col("dew_point_2m"), F.col("wind_dir_deg"))
    return table(spark, sf, FC).select("id", *[c.alias(n) for n, c in s.items()])


@query("f29_anomaly", sql(f"""WITH n AS (SELECT point_id, avg(temperature_2m) AS te FROM fx_climatology GROUP BY 1) SELECT id, {r('temperature_2m - te')} AS temp_anomaly FROM fx_forecast_runs JOIN n USING (point_id)""", FC, "fx_climatology"))
def f29(spark, sf):
    """Against the all-year mean; the windowed normals are in the climatology group."""
    n = table(spark, sf, "fx_climatology").groupBy("point_id").agg(F.avg("temperature_2m").alias("climatology_temp_normal"))
    f = table(spark, sf, FC).select("id", "point_id", F.col("temperature_2m").alias(f"fc_{REFM}_temp"), F.lit(0.0).alias(f"fc_{REFM}_speed"), F.lit(0.0).alias(f"fc_{REFM}_pressure"))
    return f.join(n, "point_id").select("id", features.anomalies()["temp_anomaly"].alias("temp_anomaly"))


@query("f31_target_bias", sql(f"SELECT id, {r(U.format(s='wind_gust_kn', d='confidence_pct') + ' - (' + U.format(s='wind_speed_kn', d='wind_dir_deg') + ')')} AS target_u, {r(V.format(s='wind_gust_kn', d='confidence_pct') + ' - (' + V.format(s='wind_speed_kn', d='wind_dir_deg') + ')')} AS target_v FROM fx_predictions", "fx_predictions"))
def f31(spark, sf):
    p = table(spark, sf, "fx_predictions").selectExpr(
        "id", "wind_gust_kn AS obs_nearest_speed", "confidence_pct AS obs_nearest_dir", f"wind_speed_kn AS fc_{REFM}_speed", f"wind_dir_deg AS fc_{REFM}_dir"
    )
    return p.select("id", *[c.alias(n) for n, c in features.targets().items()])


@query("f44_ensemble_spread", S4.replace("SELECT h.event_id, 'm_' || event_type || '_ens' AS model_name, TIMESTAMP '2024-01-20 12:00:00' AS run_time,\n  hr + h.i * INTERVAL '1' HOUR AS valid_time", "SELECT h.event_id, hr + h.i * INTERVAL '1' HOUR AS valid_time").replace(
    f"{r('value + h.i')} AS wind_speed_kn, CAST(k * 3 AS DOUBLE) AS wind_dir_deg,\n  CAST(NULL AS DOUBLE) AS wind_gust_kn, ", "").replace(f"{r('d.mean')} AS dir_mean, ", "").replace(f", {r('d.rng')} AS dir_range", ""))
def f44(spark, sf):
    """Through the stored JSON text and back."""
    rows = payload.ensemble_rows(ensemble_payloads(spark, sf), as_of()).withColumn("raw_json", F.to_json("spread"))
    s = payload.spread_from_json(F.col("raw_json"))
    return rows.select("event_id", "valid_time", *[s[c].alias(c) for c in ("n_members", "speed_mean", "speed_std", "speed_range", "dir_std", "press_std")])


GROUP_OF = """CASE WHEN starts_with(f, 'fc_') THEN 'forecast' WHEN starts_with(f, 'agree_') THEN 'agreement' WHEN starts_with(f, 'ens_') THEN 'ensemble' WHEN starts_with(f, 'foehn') THEN 'foehn' WHEN starts_with(f, 'solar') THEN 'solar'
 WHEN starts_with(f, 'thermal') THEN 'thermal_inertia' WHEN starts_with(f, 'pressure_grad') THEN 'macro_area_pressure' WHEN starts_with(f, 'stability') THEN 'stability' WHEN starts_with(f, 'lake_breeze') THEN 'lake_breeze' WHEN starts_with(f, 'lag') THEN 'persistence'
 WHEN starts_with(f, 'obs_') THEN 'ground_station' WHEN f IN ('hour_local', 'day_of_year', 'month', 'season', 'is_weekend') THEN 'temporal' WHEN contains(f, '_') THEN split_part(f, '_', 1) ELSE 'other' END"""
F45 = [f"fc_{REFM}_speed", f"fc_{REFM}_dir", f"fc_{MODELS[0]}_speed", *list(AGREE)[:2]]
F45_ALIAS = [*F45, "hour_local", "pressure"]


@query("f45_feature_groups", sql(f"""WITH {SPINE}, {OWN}, f AS (SELECT {', '.join(AGREE[c] + ' AS ' + c if c in AGREE else c for c in F45)}, hour(t) AS hour_local, fc_{REFM}_pressure AS pressure FROM wide),
n AS ({' UNION ALL '.join(f"SELECT '{c}' AS f, count({c}) AS n FROM f" for c in F45_ALIAS)})
SELECT {GROUP_OF} AS feature_group, count(*) AS n_features, sum(n)::BIGINT AS n_values FROM n GROUP BY 1""", *FX))
def f45(spark, sf):
    f = features.forecast_features(full_spine(spark, sf), table(spark, sf, FC), tie_break=TB)
    f = f.withColumns({"hour_local": F.hour("t"), "pressure": F.col(f"fc_{REFM}_pressure")})
    return features.group_counts(F45_ALIAS, f)


@query("f46_level_shear", sql(f"""SELECT event_id, hr + i * INTERVAL '1' HOUR AS valid_time, {r('value * 2 + i')} AS speed_80m, {r('CASE WHEN i < 4 THEN value END')} AS shear_10_80
FROM fx_events CROSS JOIN range(0, 6) t(i) WHERE NOT (event_id % 7 = 0 AND i = 3)""", "fx_events"))
def f46(spark, sf):
    rows = payload.forecast_rows(payloads(spark, sf), upper_air=True)
    return rows.select("event_id", "valid_time", F.col("wind_speed_80m").alias("speed_80m"), ff.shear(F.col("wind_speed_80m"), F.col("wind_speed_kn")).alias("shear_10_80"))


