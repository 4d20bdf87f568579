"""F: scalar formulas over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.fx import doubles, query, r, sql, table
from checks.lookups import RADIUS, RING_DEF, RING_FC, ring_df
from sparkmos.functions import decision, geo, timefn, weather, wind
from sparkmos.functions.common import ts
from sparkmos.functions import text as tx
from sparkmos.functions.solar import add_solar
from sparkmos.operators import spatial

PRED = "fx_predictions"
U = "-{s} * sin(radians({d}))"
V = "-{s} * cos(radians({d}))"


def uv(s: str, d: str) -> tuple[str, str]:
    return U.format(s=s, d=d), V.format(s=s, d=d)


def back(u: str, v: str) -> tuple[str, str]:
    return (
        f"CASE WHEN sqrt(pow({u}, 2) + pow({v}, 2)) < 1e-6 THEN 0 ELSE sqrt(pow({u}, 2) + pow({v}, 2)) END",
        f"CASE WHEN sqrt(pow({u}, 2) + pow({v}, 2)) < 1e-6 THEN 0 ELSE (degrees(atan2(-({u}), -({v}))) + 360) % 360 END",
    )


u0, v0 = uv("wind_speed_kn", "wind_dir_deg")


@query("f01_to_uv", sql(f"SELECT id, {r(u0)} AS u, {r(v0)} AS v FROM fx_predictions", PRED))
def f01(spark, sf):
    s, d = F.col("wind_speed_kn"), F.col("wind_dir_deg")
    return table(spark, sf, PRED).select("id", wind.u_of(s, d).alias("u"), wind.v_of(s, d).alias("v"))


F2 = "wind_gust_kn - 5", "expected_error_kn - 2"


@query("f02_from_uv", sql(f"SELECT id, {r(back(*F2)[0])} AS speed, {r(back(*F2)[1], 4)} AS direction FROM fx_predictions", PRED))
def f02(spark, sf):
    u, v = F.col("wind_gust_kn") - 5, F.col("expected_error_kn") - 2
    return table(spark, sf, PRED).select("id", wind.speed_of(u, v).alias("speed"), F.round(wind.direction_of(u, v), 4).alias("direction"))


@query("f03_direction_error", sql(f"SELECT id, {r('CASE WHEN abs(wind_dir_deg - c) > 180 THEN 360 - abs(wind_dir_deg - c) ELSE abs(wind_dir_deg - c) END')} AS err FROM (SELECT *, confidence_pct * 3 AS c FROM fx_predictions)", PRED))
def f03(spark, sf):
    return table(spark, sf, PRED).select("id", wind.direction_error(F.col("wind_dir_deg"), F.col("confidence_pct") * 3).alias("err"))


F4 = f"({u0}) + 1.5", f"({v0}) - 0.5"


@query("f04_bias_correct", sql(f"SELECT id, {r(back(*F4)[0])} AS speed, {r(back(*F4)[1], 4)} AS direction FROM fx_predictions", PRED))
def f04(spark, sf):
    s, d = F.col("wind_speed_kn"), F.col("wind_dir_deg")
    args = wind.u_of(s, d), wind.v_of(s, d), F.lit(1.5), F.lit(-0.5)
    return table(spark, sf, PRED).select("id", wind.corrected_speed(*args).alias("speed"), F.round(wind.corrected_direction(*args), 4).alias("direction"))


@query("f05_haversine", sql(f"SELECT id, {r('2 * 6371 * asin(sqrt(pow(sin(radians(lat - 46.1) / 2), 2) + cos(radians(lat)) * cos(radians(46.1)) * pow(sin(radians(lon - 9.304) / 2), 2)))')} AS km FROM fx_observations", "fx_observations"))
def f05(spark, sf):
    return table(spark, sf, "fx_observations").select("id", geo.haversine_km(F.lit(46.1), F.lit(9.304), F.col("lat"), F.col("lon")).alias("km"))


@query("f06_circular_statistics", sql(f"""SELECT point_id, {r('(degrees(atan2(sum(sin(radians(wind_dir_deg))), sum(cos(radians(wind_dir_deg))))) + 360) % 360', 4)} AS mean_dir,
  {r('1 - sqrt(pow(sum(sin(radians(wind_dir_deg))), 2) + pow(sum(cos(radians(wind_dir_deg))), 2)) / count(*)')} AS variance FROM fx_predictions GROUP BY 1""", PRED))
def f06(spark, sf):
    g = table(spark, sf, PRED).groupBy("point_id").agg(
        F.sum(F.sin(F.radians("wind_dir_deg"))).alias("s"), F.sum(F.cos(F.radians("wind_dir_deg"))).alias("c"), F.count("*").alias("n")
    )
    return g.select("point_id", F.round(wind.circular_mean(F.col("s"), F.col("c")), 4).alias("mean_dir"), wind.circular_variance(F.col("s"), F.col("c"), F.col("n")).alias("variance"))


@query("f07_units", sql(f"""SELECT id, {r('wind_speed_kn * 0.514444')} AS ms, {r('wind_speed_kn * 1.852')} AS kmh, {r('wind_speed_kn * 0.539957', 3)} AS from_kmh, {r('wind_speed_kn * 1.94384', 2)} AS from_ms,
  CASE id % 3 WHEN 0 THEN 'kn' WHEN 1 THEN 'm/s' ELSE 'km/h' END AS unit FROM fx_predictions""", PRED))
def f07(spark, sf):
    s = F.col("wind_speed_kn")
    units = F.when(F.col("id") % 3 == 0, "kn").when(F.col("id") % 3 == 1, "ms").otherwise("kmh")
    return table(spark, sf, PRED).select(
        "id", wind.in_units(s, F.lit("ms")).alias("ms"), wind.in_units(s, F.lit("kmh")).alias("kmh"), wind.kmh_to_kn(s).alias("from_kmh"),
        wind.ms_to_kn(s).alias("from_ms"), wind.unit_label(units).alias("unit"),
    )


N16 = "['N', 'NNE', 'NE', 'ENE', 'E', 'ESE', 'SE', 'SSE', 'S', 'SSW', 'SW', 'WSW', 'W', 'WNW', 'NW', 'NNW']"


@query("f08_names_16", sql(f"""SELECT id, list_extract({N16}, CAST(floor((wind_dir_deg % 360) / 22.5) AS INT) % 16 + 1) AS by_floor,
  list_extract({N16}, CAST(floor(wind_dir_deg / 22.5 + 0.5) AS INT) % 16 + 1) AS by_round FROM fx_observations""", "fx_observations"))
def f08(spark, sf):
    d = F.col("wind_dir_deg")
    return table(spark, sf, "fx_observations").select("id", wind.name_16(d).alias("by_floor"), wind.name_16(d, "round").alias("by_round"))


@query("f09_names_8", sql("SELECT id, list_extract(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'], CAST(floor(((wind_dir_deg + 22.5) % 360) / 45) AS INT) % 8 + 1) AS name FROM fx_observations", "fx_observations"))
def f09(spark, sf):
    return table(spark, sf, "fx_observations").select("id", wind.name_8(F.col("wind_dir_deg")).alias("name"))


F10 = {"n": 0.0, " NNE-NE ": 33.75, "da NNO": 0.0, "Vento da SSW": 202.5, "variabile": None, "270 º": 270.0, "400°": 40.0, "": None, "x": None, "da WNW forte": 292.5}


@query("f10_cardinal_text", sql(f"""SELECT event_id, CAST(CASE event_id % {len(F10)} {' '.join(f"WHEN {i} THEN {'NULL' if v is None else v}" for i, v in enumerate(F10.values()))} END AS DOUBLE) AS deg FROM fx_events""", "fx_events"))
def f10(spark, sf):
    t = F.get(F.array(*[F.lit(x) for x in F10]), F.pmod("event_id", F.lit(len(F10))).cast("int"))
    return table(spark, sf, "fx_events").select("event_id", tx.cardinal_deg(t).alias("deg"))


@query("f11_number_unit", sql(f"""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL WHEN 2 THEN 0 - CAST(k AS DOUBLE) ELSE {r('value')} END AS number,
  CASE event_id % 4 WHEN 0 THEN 'km/h' WHEN 2 THEN '°c' WHEN 1 THEN NULL END AS unit FROM fx_events""", "fx_events"))
def f11(spark, sf):
    m = F.col("event_id") % 4
    value = F.format_string("%.2f", "value")
    t = (
        F.when(m == 0, F.concat(F.replace(value, F.lit("."), F.lit(",")), F.lit(" km/h"))).when(m == 1, F.concat(F.lit("vento "), value))
        .when(m == 2, F.concat(F.lit("-"), F.col("k").cast("string"), F.lit(" °C"))).otherwise(F.lit("n.d."))
    )
    return table(spark, sf, "fx_events").select("event_id", tx.number_in(t).alias("number"), tx.unit_in(t).alias("unit"))


@query("f12_beaufort", sql("SELECT event_id, CAST(list_extract([0, 1, 4, 7, 11, 17, 22, 28, 35, 42, 50, 59, 68], least(k % 20, 12) + 1) AS DOUBLE) AS kn FROM fx_events", "fx_events"))
def f12(spark, sf):
    return table(spark, sf, "fx_events").select("event_id", wind.beaufort_to_kn(F.col("k") % 20).alias("kn"))


CODE_SQL = " ".join(f"WHEN {c} THEN '{v[0]}'" for c, v in weather.CODES.items())
CODE_IT = " ".join(f"WHEN {c} THEN '{v[1]}'" for c, v in weather.CODES.items())
ICON_SQL = " ".join(f"WHEN {c} THEN '{v[2]}'" for c, v in weather.CODES.items())


@query("f13_weather_code", sql(f"SELECT id, CASE weather_code {CODE_SQL} ELSE 'Unknown' END AS en, CASE weather_code {CODE_IT} ELSE 'Unknown' END AS it, CASE weather_code {ICON_SQL} ELSE '❓' END AS icon FROM fx_forecast_runs", "fx_forecast_runs"))
def f13(spark, sf):
    c = F.col("weather_code")
    return table(spark, sf, "fx_forecast_runs").select("id", weather.description(c).alias("en"), weather.description(c, "it").alias("it"), weather.icon(c).alias("icon"))


CODE_NULL = "(SELECT id, wind_speed_kn, visibility, CASE WHEN id % 10 <> 0 THEN weather_code END AS c FROM fx_forecast_runs)"
RAIN, SNOW, STORM, FOG = "c BETWEEN 51 AND 67 OR c BETWEEN 80 AND 82", "c BETWEEN 71 AND 77 OR c BETWEEN 85 AND 86", "c BETWEEN 95 AND 99", "c IN (45, 48)"


@query("f14_weather_flags", sql(f"SELECT id, {', '.join(f'coalesce({e}, FALSE) AS {n}' for n, e in (('rainy', RAIN), ('snowy', SNOW), ('stormy', STORM), ('foggy', FOG)))} FROM {CODE_NULL}", "fx_forecast_runs"))
def f14(spark, sf):
    c = F.when(F.col("id") % 10 != 0, F.col("weather_code"))
    return table(spark, sf, "fx_forecast_runs").select("id", weather.is_rainy(c).alias("rainy"), weather.is_snowy(c).alias("snowy"), weather.is_stormy(c).alias("stormy"), weather.is_foggy(c).alias("foggy"))


@query("f15_sailing_warning", sql(f"""SELECT id, CASE WHEN {STORM} THEN '{weather.WARNINGS['storm']}' WHEN {SNOW} THEN '{weather.WARNINGS['snow']}' WHEN {FOG} OR visibility < 1000 THEN '{weather.WARNINGS['fog']}'
  WHEN ({RAIN}) AND wind_speed_kn > 15 THEN '{weather.WARNINGS['rain']}' END AS warning FROM {CODE_NULL}""", "fx_forecast_runs"))
def f15(spark, sf):
    c = F.when(F.col("id") % 10 != 0, F.col("weather_code"))
    return table(spark, sf, "fx_forecast_runs").select("id", weather.sailing_warning(c, F.col("wind_speed_kn"), F.col("visibility")).alias("warning"))


@query("f16_sail_decision", sql("SELECT id, CASE WHEN wind_speed_kn >= 8 AND confidence_pct >= 50 THEN 'GO' WHEN wind_speed_kn >= 5 AND confidence_pct >= 40 THEN 'MARGINAL' ELSE 'STAY' END AS decision FROM fx_predictions", PRED))
def f16(spark, sf):
    return table(spark, sf, PRED).select("id", decision.sail_decision(F.col("wind_speed_kn"), F.col("confidence_pct")).alias("decision"))


@query("f17_bands", sql("""SELECT id, CASE WHEN wind_gust_kn < 5 THEN 'calm' WHEN wind_gust_kn < 10 THEN 'sailing' WHEN wind_gust_kn < 16 THEN 'good' WHEN wind_gust_kn < 22 THEN 'strong' ELSE 'very_strong' END AS band,
  CASE WHEN confidence_pct >= 75 THEN 'high' WHEN confidence_pct >= 50 THEN 'medium' ELSE 'low' END AS conf_band FROM fx_predictions""", PRED))
def f17(spark, sf):
    return table(spark, sf, PRED).select("id", decision.speed_band(F.col("wind_gust_kn")).alias("band"), decision.confidence_band(F.col("confidence_pct")).alias("conf_band"))


ROME = "(timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome')"


@query("f18_local_calendar", sql(f"""SELECT point_id, timestamp, {ROME} AS local_time, hour({ROME}) AS hour_local, dayofyear({ROME}) AS day_of_year, month({ROME}) AS month,
  CASE WHEN month({ROME}) IN (12, 1, 2) THEN 0 WHEN month({ROME}) <= 5 THEN 1 WHEN month({ROME}) <= 8 THEN 2 ELSE 3 END::BIGINT AS season, isodow({ROME}) >= 6 AS is_weekend, count(*) AS n FROM fx_climatology GROUP BY ALL""", "fx_climatology"))
def f18(spark, sf):
    """Seven years of hours, so both clock changes are in."""
    lt = timefn.local("timestamp")
    c = table(spark, sf, "fx_climatology").groupBy("point_id", "timestamp").agg(F.count("*").alias("n"))
    return c.select("point_id", "timestamp", lt.alias("local_time"), "n", *[v.alias(k) for k, v in timefn.calendar(lt).items()])


CLOCK = f"strftime({ROME}, '%H:%M')"


@query("f19_window_flags", sql(f"""SELECT id, {CLOCK} BETWEEN '08:30' AND '09:30' AS tivano_dying, {CLOCK} BETWEEN '10:30' AND '11:00' AS breva_building,
  {CLOCK} BETWEEN '10:00' AND '18:00' AS breva_window, {CLOCK} BETWEEN '04:00' AND '09:30' AS tivano_window FROM fx_observations""", "fx_observations"))
def f19(spark, sf):
    return table(spark, sf, "fx_observations").select("id", *[v.alias(k) for k, v in timefn.window_flags(timefn.local("timestamp")).items()])


QUIET = """SELECT telegram_user_id, t, (SELECT CASE WHEN a <= b THEN m BETWEEN a AND b ELSE m >= a OR m <= b END FROM (SELECT
  hour(l) * 60 + minute(l) AS m, CAST(left(quiet_hours_start, 2) AS INT) * 60 + CAST(right(quiet_hours_start, 2) AS INT) AS a, CAST(left(quiet_hours_end, 2) AS INT) * 60 + CAST(right(quiet_hours_end, 2) AS INT) AS b)) AS quiet
FROM (SELECT *, t AT TIME ZONE 'UTC' AT TIME ZONE timezone AS l FROM fx_users CROSS JOIN range(TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-21', INTERVAL '1' HOUR) g(t))"""


@query("f20_quiet_hours", sql(QUIET, "fx_users"))
def f20(spark, sf):
    hours = F.explode(F.sequence(ts("2024-01-20 00:00:00"), ts("2024-01-20 23:00:00"), F.expr("INTERVAL '1' HOUR")))
    u = table(spark, sf, "fx_users").withColumn("t", hours)
    quiet = timefn.in_quiet_hours(timefn.local("t", F.col("timezone")), F.col("quiet_hours_start"), F.col("quiet_hours_end"))
    return u.select("telegram_user_id", "t", quiet.alias("quiet"))


SOLAR_STAGE = """{p}1 AS (SELECT *, ({jd} - 2451545) / 36525 AS jc FROM {src}),
{p}2 AS (SELECT *, (280.46646::DOUBLE + jc * (36000.76983 + jc * 0.0003032)) AS l0r, 357.52911::DOUBLE + jc * (35999.05029 - 0.0001537 * jc) AS m, 0.016708634::DOUBLE - jc * (0.000042037 + 0.0000001267 * jc) AS e FROM {p}1),
{p}3 AS (SELECT *, l0r - 360 * floor(l0r / 360) AS l0, sin(radians(m)) * (1.914602 - jc * (0.004817 + 0.000014 * jc)) + sin(radians(2 * m)) * (0.019993 - 0.000101 * jc) + sin(radians(3 * m)) * 0.000289 AS c,
  125.04 - 1934.136 * jc AS nd FROM {p}2),
{p}4 AS (SELECT *, l0 + c - 0.00569 - 0.00478 * sin(radians(nd)) AS app, 23 + (26 + (21.448 - jc * (46.815 + jc * (0.00059 - jc * 0.001813))) / 60) / 60 + 0.00256 * cos(radians(nd)) AS ob FROM {p}3),
{p}5 AS (SELECT *, degrees(asin(sin(radians(ob)) * sin(radians(app)))) AS {d}, pow(tan(radians(ob / 2)), 2) AS y FROM {p}4),
{p} AS (SELECT * EXCLUDE (jc, l0r, m, e, l0, c, nd, app, ob, y), 4 * degrees(y * sin(radians(2 * l0)) - 2 * e * sin(radians(m)) + 4 * e * y * sin(radians(m)) * cos(radians(2 * l0)) - 0.5 * y * y * sin(radians(4 * l0)) - 1.25 * e * e * sin(radians(2 * m))) AS {q} FROM {p}5)"""
HA = "CASE WHEN abs(cos(radians(90.8333)) / (cos(radians(lat)) * cos(radians({d}))) - tan(radians(lat)) * tan(radians({d}))) <= 1 THEN degrees(acos(cos(radians(90.8333)) / (cos(radians(lat)) * cos(radians({d}))) - tan(radians(lat)) * tan(radians({d})))) END"


def stage(p, src, jd):
    return SOLAR_STAGE.format(p=p, src=src, jd=jd, d=f"{p}_d", q=f"{p}_q")


SOLAR = f"""base AS (SELECT DISTINCT p.point_id, p.lat, p.lon, c.timestamp AS t FROM fx_climatology c JOIN fx_points p USING (point_id)),
base2 AS (SELECT *, epoch(t) / 60 AS em, epoch_ms(CAST(t AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome' AS DATE)) / 86400000 AS dn FROM (SELECT * FROM base)),
{stage('n', 'base2', 'em / 1440 + 2440587.5')},
z0 AS (SELECT *, (em - 1440 * floor(em / 1440) + n_q + 4 * lon) AS tst0 FROM n),
z1 AS (SELECT *, (tst0 - 1440 * floor(tst0 / 1440)) / 4 - 180 AS ha FROM z0),
z AS (SELECT *, degrees(acos(greatest(-1, least(1, sin(radians(lat)) * sin(radians(n_d)) + cos(radians(lat)) * cos(radians(n_d)) * cos(radians(ha)))))) AS zen FROM z1),
{stage('dd', 'z', 'dn + 2440587.5 + 0.5')},
rs AS (SELECT *, 720 - 4 * lon - dd_q - 4 * {HA.format(d='dd_d')} AS rise0, 720 - 4 * lon - dd_q + 4 * {HA.format(d='dd_d')} AS set0 FROM dd),
{stage('ri', 'rs', 'dn + 2440587.5 + rise0 / 1440')}, {stage('se', 'ri', 'dn + 2440587.5 + set0 / 1440')},
sun AS (SELECT *, em - dn * 1440 AS tm, 720 - 4 * (lon + {HA.format(d='ri_d')}) - ri_q AS rise, 720 - 4 * (lon - {HA.format(d='se_d')}) - se_q AS sset, 90 - zen AS el,
  degrees(acos(greatest(-1, least(1, (sin(radians(lat)) * cos(radians(zen)) - sin(radians(n_d))) / (cos(radians(lat)) * sin(radians(zen))))))) AS ang FROM se)"""
REFRACT = "CASE WHEN el > 85 THEN 0 WHEN el > 5 THEN 58.1 / tan(radians(el)) - 0.07 / pow(tan(radians(el)), 3) + 0.000086 / pow(tan(radians(el)), 5) WHEN el > -0.575 THEN 1735 + el * (-518.2 + el * (103.4 + el * (-12.79 + el * 0.711))) ELSE -20.772 / tan(radians(el)) END / 3600"


@query("f22_solar_geometry", sql(f"""WITH {SOLAR} SELECT point_id, t, {r(f'el + {REFRACT}', 4)} AS solar_elevation, {r('CASE WHEN ha > 0 THEN (ang + 180) % 360 ELSE (540 - ang) % 360 END', 3)} AS solar_azimuth,
  tm >= rise AND tm <= sset AS solar_is_daytime, CASE WHEN tm >= rise AND tm <= sset THEN {r('tm - rise', 3)} END AS solar_minutes_since_sunrise,
  CASE WHEN tm >= rise AND tm <= sset THEN {r('sset - tm', 3)} END AS solar_minutes_until_sunset, {r('sset - rise', 3)} AS solar_day_length_min FROM sun""", "fx_climatology"))
def f22(spark, sf):
    p = table(spark, sf, "fx_points").select("point_id", "lat", "lon")
    c = table(spark, sf, "fx_climatology").select("point_id", F.col("timestamp").alias("t")).distinct().join(p, "point_id")
    s = add_solar(c, "t")
    return s.select(
        "point_id", "t", F.round("solar_elevation", 4).alias("solar_elevation"), F.round("solar_azimuth", 3).alias("solar_azimuth"), "solar_is_daytime",
        *[F.round(x, 3).alias(x) for x in ("solar_minutes_since_sunrise", "solar_minutes_until_sunset", "solar_day_length_min")],
    )


@query("f30_observation_confidence", sql(f"SELECT id, {r('CASE WHEN id % 6 = 0 THEN 0 ELSE 1 / (1 + confidence_pct / 5 + greatest(0, wind_speed_kn - 3) / 30) END')} AS c FROM fx_predictions", PRED))
def f30(spark, sf):
    d = F.when(F.col("id") % 6 != 0, F.col("confidence_pct"))
    return table(spark, sf, PRED).select("id", decision.observation_confidence(d, F.col("wind_speed_kn") - 3).alias("c"))


@query("f36_regime_rules", sql(f"""WITH b AS (SELECT id, strftime(valid_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome', '%H:%M') AS c, pressure_msl - 1020 >= 8 AS fl, pressure_msl - 1020 >= 12 AS fs, cape > 1000 AS hc,
  (wind_speed_kn < 3 AND wind_speed_kn <> 0) AS lo, wind_speed_kn > 18 AS st FROM (SELECT * REPLACE (wind_speed_kn * 5 AS wind_speed_kn) FROM fx_forecast_runs)),
g AS (SELECT *, coalesce(fs, FALSE) AS s, coalesce(fl, FALSE) AS l FROM b)
SELECT id, CASE WHEN s THEN 'foehn' WHEN hc AND st THEN 'storm' WHEN l THEN 'foehn' WHEN c BETWEEN '10:00' AND '18:00' AND NOT lo THEN 'breva' WHEN c BETWEEN '04:00' AND '09:30' AND NOT lo THEN 'tivano' ELSE 'calm' END AS regime,
  CAST(CASE WHEN s THEN 0.95 WHEN hc AND st THEN 0.85 WHEN l THEN 0.8 WHEN c BETWEEN '10:00' AND '18:00' AND NOT lo THEN 0.75 WHEN c BETWEEN '04:00' AND '09:30' AND NOT lo THEN 0.75 ELSE 0.6 END AS DOUBLE) AS confidence,
  (s::INT + l::INT + hc::INT + lo::INT + st::INT + (c BETWEEN '10:00' AND '18:00')::INT + (c BETWEEN '04:00' AND '09:30')::INT)::BIGINT AS n_fired FROM g""", "fx_forecast_runs"))
def f36(spark, sf):
    f = table(spark, sf, "fx_forecast_runs").withColumn("wind_speed_kn", F.col("wind_speed_kn") * 5)
    grad = F.col("pressure_msl") - 1020
    rules = decision.regime_rules(timefn.hhmm(timefn.local("valid_time")), grad >= 8, grad >= 12, F.col("cape"), F.col("wind_speed_kn"))
    label, conf = decision.regime(rules)
    fired = F.map_filter(F.create_map(*[x for n, c in rules.items() for x in (F.lit(n), c)]), lambda _, v: v)
    return f.select("id", label.alias("regime"), conf.alias("confidence"), F.size(fired).alias("n_fired"))


WATER = [(x, y) for x, y in geo.SHORELINE]
POLY = ", ".join(f"({i}, {x}, {y})" for i, (x, y) in enumerate(WATER))
SHORE_EDGES = f"""v AS (SELECT i, x::DOUBLE AS x, y::DOUBLE AS y FROM (VALUES {POLY}) t(i, x, y)),
e AS (SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.i = (a.i + 1) % {len(WATER)})"""
F39 = sql(f"""WITH {SHORE_EDGES},
o AS (SELECT DISTINCT lat, lon FROM fx_observations),
d AS (SELECT lat, lon, count(*) FILTER (WHERE (y1 > lat) <> (y2 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2) % 2 = 1 AS on_water,
  min(sqrt(pow(lon - (x1 + greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (x2 - x1)), 2)
    + pow(lat - (y1 + greatest(0, least(1, ((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / (pow(x2 - x1, 2) + pow(y2 - y1, 2)))) * (y2 - y1)), 2))) * 111000 AS m FROM o CROSS JOIN e GROUP BY ALL)
SELECT {doubles('lat lon')}, on_water, {r('m', 3)} AS distance_m, CASE WHEN on_water THEN 'on_water' WHEN m < 300 THEN 'near_shore' ELSE 'on_land' END AS status FROM d""", "fx_observations")


@query("f39_shoreline", F39)
def f39(spark, sf):
    o = table(spark, sf, "fx_observations").select("lat", "lon").distinct()
    d = o.withColumns({"on_water": geo.inside_polygon(F.col("lon"), F.col("lat")), "m": geo.distance_to_polygon_m(F.col("lon"), F.col("lat"))})
    return d.select("lat", "lon", "on_water", F.round("m", 3).alias("distance_m"), geo.shore_status(F.col("on_water"), F.col("m"), F.lit(True)).alias("status"))


@query("f40_compass_ring", sql(f"""SELECT DISTINCT o.lat AS center_lat, o.lon AS center_lon, direction, {r(f'o.lat + dy * {RADIUS}::DOUBLE / 111')} AS lat, {r(f'o.lon + dx * {RADIUS}::DOUBLE / (111 * cos(radians(o.lat)))')} AS lon
FROM (SELECT DISTINCT lat, lon FROM fx_observations) o CROSS JOIN {RING_DEF}""", "fx_observations"))
def f40(spark, sf):
    o = table(spark, sf, "fx_observations").select(F.col("lat").alias("center_lat"), F.col("lon").alias("center_lon")).distinct()
    return o.select("center_lat", "center_lon", F.inline(geo.compass_ring(F.col("center_lat"), F.col("center_lon"), RADIUS)))


@query("f41_map_tiles", sql(f"""WITH t AS (SELECT DISTINCT lat, lon, CAST(floor((lon + 180) / 360 * 8192) AS BIGINT) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 8192) AS BIGINT) AS y FROM fx_observations)
SELECT {doubles('lat lon')}, x, y, {r('x / 8192.0::DOUBLE * 360 - 180')} AS lon_min, {r('degrees(atan(sinh(pi() * (1 - 2 * y / 8192.0::DOUBLE))))')} AS lat_max FROM t""", "fx_observations"))
def f41(spark, sf):
    o = table(spark, sf, "fx_observations").select("lat", "lon").distinct().withColumns({"x": geo.tile_x(F.col("lon"), 13), "y": geo.tile_y(F.col("lat"), 13)})
    b = geo.tile_bounds(F.col("x"), F.col("y"), 13)
    return o.select("lat", "lon", "x", "y", b["lon_min"].alias("lon_min"), b["lat_max"].alias("lat_max"))


AXES_SQL = ", ".join(
    f"{r(f'''max({c}) FILTER (WHERE direction = '{a}') - max({c}) FILTER (WHERE direction = '{b}')''', 2)} AS grid_{n}_grad_{x}"
    for c, n in (("pressure", "pressure"), ("temperature", "temp")) for x, (a, b) in spatial.AXES.items()
)


@query("f47_ring_gradients", sql(f"WITH {RING_FC} SELECT point_id, t, {AXES_SQL} FROM ring_fc GROUP BY ALL", "fx_points", "fx_forecast_runs"))
def f47(spark, sf):
    g = spatial.ring_features(ring_df(spark, sf))
    return g.select("point_id", "t", *[f"grid_{n}_grad_{x}" for n in ("pressure", "temp") for x in spatial.AXES])


