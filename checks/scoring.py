"""D5, D7-D14, D21, A10-A15, A17, A18 and F32-F37, with a formula in place of the learned bias."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from checks.featureset import JOINED, TB, features_df
from checks.fx import as_of, doubles, query, r, sql, table
from checks.lookups import PAIRS, nearest_sql, pairs_df, full_spine
from checks.scalars import U, V, back
from sparkmos import settings as cfg
from sparkmos.functions import decision
from sparkmos.operators import crossval, serve, verify
from sparkmos.plans import evaluation, features, inference, spine

FX = ("fx_points", "fx_forecast_runs", "fx_observations")
START, END = datetime(2024, 1, 1), datetime(2024, 1, 31)
BT = dict(train_days=7, test_days=5, step_days=3)
GROUPS, N_TEST = 6, 2

# The stand-in for the learned bias: a function of the hour and the reference wind.
BIAS = {
    "bias_u_q50": "0.5 + (hour_local % 5) / 10.0D", "bias_v_q50": "ref_speed_kn / 20 - 0.3",
    "bias_u_q10": "-0.5 - (hour_local % 7) / 10.0D", "bias_u_q90": "1.5D", "bias_v_q10": "-1.25D", "bias_v_q90": "0.75 + ref_speed_kn / 10",
}


def stubbed(df):
    return df.selectExpr("*", *[f"{e} AS {n}" for n, e in BIAS.items()])


def served_df(spark, sf):
    return inference.served_forecast(stubbed(features_df(spark, sf)))


u0, v0 = U.format(s="rs", d="rd"), V.format(s="rs", d="rd")
SPD, DIR = back(f"({u0} + bias_u_q50)", f"({v0} + bias_v_q50)")
CONF = "greatest(10, least(99, greatest(20, least(95, 95 - 9 * err)) - CASE WHEN dist_km IS NULL THEN 3 ELSE 0 END - 5 * (5 - n_models)))"
SERVED = f"""{JOINED},
b0 AS (SELECT *, coalesce(fc_icon_eu_speed, 0) AS rs, coalesce(fc_icon_eu_dir, 0) AS rd FROM j0),
b1 AS (SELECT *, 0.5 + (lh % 5) / 10.0::DOUBLE AS bias_u_q50, rs / 20 - 0.3 AS bias_v_q50, -0.5 - (lh % 7) / 10.0::DOUBLE AS bias_u_q10, 1.5::DOUBLE AS bias_u_q90, -1.25::DOUBLE AS bias_v_q10, 0.75 + rs / 10 AS bias_v_q90 FROM b0),
b2 AS (SELECT *, {SPD} AS sp, {DIR} AS dr, sqrt(pow(bias_u_q90 - bias_u_q10, 2) + pow(bias_v_q90 - bias_v_q10, 2)) / 2 AS err FROM b1),
b3 AS (SELECT *, CASE WHEN rs > 0.1 THEN sp * (fc_icon_eu_gust / rs) ELSE fc_icon_eu_gust END AS g0 FROM b2),
b4 AS (SELECT *, CASE WHEN g0 < 0.9 * sp THEN 1.3 * sp ELSE g0 END AS g1 FROM b3),
served AS (SELECT *, {r('sp', 2)} AS wind_speed_kn, {r('dr', 1)} AS wind_dir_deg, {r('CASE WHEN g1 > 3 * sp THEN 2.5 * sp ELSE g1 END', 2)} AS wind_gust_kn,
  {r(CONF, 1)} AS confidence_pct, {r('err', 2)} AS expected_error_kn FROM b4)"""
SERVED_COLS = "wind_speed_kn wind_dir_deg wind_gust_kn confidence_pct expected_error_kn"


@query("d05_served_forecast", sql(f"WITH {SERVED} SELECT point_id, t AS valid_time, {doubles(SERVED_COLS)} FROM served", *FX))
def d05(spark, sf):
    return served_df(spark, sf).select("point_id", "valid_time", *SERVED_COLS.split())


@query("f32_expected_error", sql(f"SELECT id, {r('sqrt(pow(wind_gust_kn - wind_speed_kn, 2) + pow(expected_error_kn - 1, 2)) / 2')} AS err FROM fx_predictions", "fx_predictions"))
def f32(spark, sf):
    c = F.col
    return table(spark, sf, "fx_predictions").select("id", decision.expected_error(c("wind_speed_kn"), c("wind_gust_kn"), F.lit(1.0), c("expected_error_kn")).alias("err"))


@query("f33_confidence", sql(f"SELECT id, {r('greatest(10, least(99, greatest(20, least(95, 95 - 9 * expected_error_kn)) - CASE WHEN id % 4 = 0 THEN 3 ELSE 0 END - 5 * greatest(0, 5 - id % 7)))')} AS conf FROM fx_predictions", "fx_predictions"))
def f33(spark, sf):
    return table(spark, sf, "fx_predictions").select("id", decision.confidence(F.col("expected_error_kn"), F.col("id") % 4 == 0, F.col("id") % 7).alias("conf"))


G34 = "CASE WHEN wind_speed_kn > 0.1 THEN expected_error_kn * 3 * (wind_gust_kn / wind_speed_kn) ELSE wind_gust_kn END"
G34B = f"CASE WHEN {G34} < 0.9 * expected_error_kn * 3 THEN 1.3 * expected_error_kn * 3 ELSE {G34} END"


@query("f34_gust", sql(f"SELECT id, {r(f'CASE WHEN {G34B} > 3 * expected_error_kn * 3 THEN 2.5 * expected_error_kn * 3 ELSE {G34B} END')} AS gust FROM (SELECT * REPLACE (CASE WHEN id % 6 = 0 THEN 0.05 ELSE wind_speed_kn END AS wind_speed_kn, CASE WHEN id % 5 = 0 THEN wind_gust_kn * 4 WHEN id % 7 = 0 THEN wind_gust_kn / 4 ELSE wind_gust_kn END AS wind_gust_kn) FROM fx_predictions)", "fx_predictions"))
def f34(spark, sf):
    p = table(spark, sf, "fx_predictions").withColumns(
        {
            "wind_speed_kn": F.when(F.col("id") % 6 == 0, 0.05).otherwise(F.col("wind_speed_kn")),
            "wind_gust_kn": F.when(F.col("id") % 5 == 0, F.col("wind_gust_kn") * 4).when(F.col("id") % 7 == 0, F.col("wind_gust_kn") / 4).otherwise(F.col("wind_gust_kn")),
        }
    )
    return p.select("id", decision.gust_from_ratio(F.col("wind_gust_kn"), F.col("wind_speed_kn"), F.col("expected_error_kn") * 3).alias("gust"))


@query("f35_quantile_crossing", sql(f"""SELECT id, wind_speed_kn > expected_error_kn OR expected_error_kn > wind_gust_kn AS crossed, {r('least(wind_speed_kn, expected_error_kn, wind_gust_kn)')} AS q10,
  {r('greatest(wind_speed_kn, expected_error_kn, wind_gust_kn)')} AS q90 FROM fx_predictions""", "fx_predictions"))
def f35(spark, sf):
    a, b, c = F.col("wind_speed_kn"), F.col("expected_error_kn"), F.col("wind_gust_kn")
    s = decision.sorted_quantiles(a, b, c)
    return table(spark, sf, "fx_predictions").select("id", decision.quantiles_cross(a, b, c).alias("crossed"), s[0].alias("q10"), s[2].alias("q90"))


@query("f37_conformal_shift", sql(f"""WITH q AS (SELECT *, CASE id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 ELSE 0.9 END AS q, CASE WHEN id % 10 <> 0 THEN expected_error_kn / 10 END AS e FROM fx_predictions)
SELECT id, {r('wind_speed_kn + CASE WHEN q < 0.5 THEN -1 WHEN q > 0.5 THEN 1 ELSE 0 END * 0.25 * CASE WHEN e >= 0.1 THEN e / 0.1 ELSE 1 END')} AS shifted, {r('0.25 * CASE WHEN e > 0.1 THEN e / 0.1 ELSE 1 END')} AS margin FROM q""", "fx_predictions"))
def f37(spark, sf):
    q = F.when(F.col("id") % 3 == 0, 0.1).when(F.col("id") % 3 == 1, 0.5).otherwise(0.9)
    e = F.when(F.col("id") % 10 != 0, F.col("expected_error_kn") / 10)
    return table(spark, sf, "fx_predictions").select(
        "id", decision.conformal_shift(F.col("wind_speed_kn"), F.lit(0.25), q, e).alias("shifted"), decision.conformal_margin(F.lit(0.25), e).alias("margin")
    )


FALLBACK = """targets AS (SELECT point_id, t AS target FROM fx_points CROSS JOIN range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL '1' HOUR) g(t)),
stored AS (SELECT * FROM (SELECT q.point_id, q.target, p.* EXCLUDE (point_id), row_number() OVER (PARTITION BY q.point_id, q.target ORDER BY abs(date_diff('microsecond', p.valid_time, q.target)), p.generated_at DESC, p.valid_time, p.id DESC) AS rn
  FROM targets q JOIN fx_predictions p ON p.point_id = q.point_id AND abs(date_diff('microsecond', p.valid_time, q.target)) <= 3600000000) WHERE rn = 1),
per_model AS (SELECT * FROM (SELECT q.point_id, q.target, f.* EXCLUDE (point_id), row_number() OVER (PARTITION BY q.point_id, q.target, f.model_name ORDER BY f.run_time DESC, abs(date_diff('minute', f.valid_time, q.target)), f.valid_time, f.id DESC) AS rn
  FROM targets q JOIN fx_forecast_runs f ON f.point_id = q.point_id AND abs(date_diff('minute', f.valid_time, q.target)) <= 60) WHERE rn = 1),
raw_fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id, target ORDER BY (model_name <> 'icon_eu')::INT, model_name) AS k FROM per_model) WHERE k = 1 AND wind_speed_kn IS NOT NULL AND wind_dir_deg IS NOT NULL)"""


@query("d07_raw_fallback", sql(f"""WITH {FALLBACK} SELECT q.point_id, q.target, coalesce(s.model_version, 'raw_' || f.model_name) AS model_version,
  CASE WHEN s.id IS NOT NULL THEN {r('s.wind_speed_kn')} ELSE {r('f.wind_speed_kn', 1)} END AS wind_speed_kn, CASE WHEN s.id IS NOT NULL THEN {r('s.wind_dir_deg')} ELSE {r('f.wind_dir_deg', 0)} END AS wind_dir_deg,
  CASE WHEN s.id IS NOT NULL THEN {r('s.wind_gust_kn')} ELSE {r('f.wind_gust_kn')} END AS wind_gust_kn, CASE WHEN s.id IS NOT NULL THEN s.confidence_pct ELSE 50 END AS confidence_pct,
  CASE WHEN s.id IS NOT NULL THEN {r('s.expected_error_kn')} ELSE 3 END AS expected_error_kn
FROM targets q LEFT JOIN stored s USING (point_id, target) LEFT JOIN raw_fc f USING (point_id, target) WHERE s.id IS NOT NULL OR f.id IS NOT NULL""", "fx_predictions", "fx_forecast_runs"))
def d07(spark, sf):
    t = full_spine(spark, sf).select("point_id", F.col("t").alias("target"))
    return serve.with_raw_fallback(t, table(spark, sf, "fx_predictions"), table(spark, sf, "fx_forecast_runs"), TB)


HORIZON_SPINE = "spine AS (SELECT p.point_id, p.idx, p.lat, p.lon, TIMESTAMP '2024-01-20 12:00:00' + h * INTERVAL '1' HOUR AS t FROM fx_points p CROSS JOIN (VALUES (0), (1), (3), (6), (24)) g(h) WHERE p.is_operational)"
CYCLE = SERVED.replace(SERVED[: SERVED.index("times AS")], HORIZON_SPINE + ", ", 1)


@query("d08_prediction_cycle", sql(f"WITH {CYCLE} SELECT point_id, t AS valid_time, TIMESTAMP '2024-01-20 12:00:00' AS generated_at, 'stub' AS model_version, {doubles(SERVED_COLS)} FROM served", *FX))
def d08(spark, sf):
    p = table(spark, sf, "fx_points").filter("is_operational")
    f = features.build_features(spine.horizon_spine(p, as_of()), table(spark, sf, "fx_forecast_runs"), table(spark, sf, "fx_observations"), cfg.OPERATIONAL, tie_break=TB)
    rows = inference.prediction_rows(inference.served_forecast(stubbed(f)), as_of(), "stub")
    return rows.select("point_id", "valid_time", "generated_at", "model_version", *SERVED_COLS.split())


@query("d09_walk_forward_windows", sql("""SELECT i AS window_id, TIMESTAMP '2024-01-01' + i * INTERVAL '3' DAY AS train_start, TIMESTAMP '2024-01-08' + i * INTERVAL '3' DAY AS train_end,
  TIMESTAMP '2024-01-08' + i * INTERVAL '3' DAY AS test_start, TIMESTAMP '2024-01-13' + i * INTERVAL '3' DAY AS test_end, (SELECT count(*) FROM fx_forecast_runs f WHERE f.valid_time >= TIMESTAMP '2024-01-08' + i * INTERVAL '3' DAY AND f.valid_time < TIMESTAMP '2024-01-13' + i * INTERVAL '3' DAY) AS n
FROM range(0, 20) t(i) WHERE TIMESTAMP '2024-01-13' + i * INTERVAL '3' DAY <= TIMESTAMP '2024-01-31'""", "fx_forecast_runs"))
def d09(spark, sf):
    w = crossval.walk_forward_windows(spark, START, END, **BT)
    n = crossval.with_windows(table(spark, sf, "fx_forecast_runs").select("valid_time"), START, END, **BT).groupBy("window_id").agg(F.count("*").alias("n"))
    return w.join(n, "window_id", "left")


EVAL = f"""{SERVED}, {nearest_sql(30, 120, name='pers')},
e0 AS (SELECT s.point_id, s.t, o_source, rs, rd, wind_speed_kn AS cs, wind_dir_deg AS cd, expected_error_kn AS ce, lh, strftime(lt, '%H:%M') AS clk, coalesce(p_zurich - p_milano >= 8, FALSE) AS foehn,
  {U.format(s='rs', d='rd')} + ({U.format(s='o_speed', d='o_dir')} - ({U.format(s='fc_icon_eu_speed', d='fc_icon_eu_dir')})) AS ou, {V.format(s='rs', d='rd')} + ({V.format(s='o_speed', d='o_dir')} - ({V.format(s='fc_icon_eu_speed', d='fc_icon_eu_dir')})) AS ov
  FROM served s WHERE o_speed IS NOT NULL AND o_dir IS NOT NULL AND fc_icon_eu_speed IS NOT NULL AND fc_icon_eu_dir IS NOT NULL),
e1 AS (SELECT *, {back('ou', 'ov')[0]} AS os, {back('ou', 'ov')[1]} AS od FROM e0)"""


def aerr(a: str, b: str) -> str:
    return f"abs(pmod_({a} - {b} + 180) - 180)".replace(f"pmod_({a} - {b} + 180)", f"(({a} - {b} + 180) - 360 * floor(({a} - {b} + 180) / 360))")


ERRORS = f"""{EVAL},
err AS (SELECT e.*, p.wind_speed_kn AS ps, abs(cs - os) AS cand_err, {aerr('cd', 'od')} AS cand_dir_err, abs(p.wind_speed_kn - os) AS pers_err, {aerr('p.wind_dir_deg', 'od')} AS pers_dir_err, abs(rs - os) AS nwp_err, {aerr('rd', 'od')} AS nwp_dir_err,
  (os BETWEEN greatest(0, cs - ce) AND cs + ce)::INT AS covered, CASE WHEN lh BETWEEN 11 AND 16 THEN ((cs >= 8) = (os >= 8))::INT END AS hit, o_source = 'era5_reanalysis' AS era5,
  CASE WHEN clk BETWEEN '10:00' AND '18:00' THEN 'breva' WHEN clk BETWEEN '04:00' AND '09:30' THEN 'tivano' WHEN foehn THEN 'foehn' ELSE 'calm' END AS regime
  FROM e1 e LEFT JOIN pers p ON p.point_id = e.point_id AND p.t = e.t),
win AS (SELECT TIMESTAMP '2024-01-08' + i * INTERVAL '3' DAY AS a, i AS window_id FROM range(0, 20) t(i) WHERE TIMESTAMP '2024-01-13' + i * INTERVAL '3' DAY <= TIMESTAMP '2024-01-31'),
we AS (SELECT err.*, window_id FROM err JOIN win ON t >= a AND t < a + INTERVAL '5' DAY)"""


def skill(c: str, b: str) -> str:
    return f"CASE WHEN avg({b}) > 0 THEN (1 - avg({c}) / avg({b})) * 100 ELSE 0 END"


SCORE_SQL = {
    "candidate_mae_kn": ("avg(cand_err)", 3), "candidate_dir_error_deg": ("avg(cand_dir_err)", 2), "persistence_mae_kn": ("avg(pers_err)", 3), "persistence_dir_error_deg": ("avg(pers_dir_err)", 2),
    "raw_nwp_mae_kn": ("avg(nwp_err)", 3), "raw_nwp_dir_error_deg": ("avg(nwp_dir_err)", 2), "confidence_interval_coverage_pct": ("avg(covered) * 100", 2), "decision_precision_pct": ("avg(hit) * 100", 2),
    "candidate_mae_vs_era5": ("avg(cand_err) FILTER (WHERE era5)", 3), "candidate_mae_vs_real": ("avg(cand_err) FILTER (WHERE NOT era5)", 3), "nwp_mae_vs_era5": ("avg(nwp_err) FILTER (WHERE era5)", 3), "nwp_mae_vs_real": ("avg(nwp_err) FILTER (WHERE NOT era5)", 3),
    "mae_reduction_vs_raw_nwp_pct": (skill("cand_err", "nwp_err"), 2), "mae_reduction_vs_persistence_pct": (skill("cand_err", "pers_err"), 2), "dir_error_reduction_pct": (skill("cand_dir_err", "nwp_dir_err"), 2),
}
SCORES = ", ".join(f"{r(e, d)} AS {n}" for n, (e, d) in SCORE_SQL.items())
MET = " AND ".join(f"{SCORE_SQL[n][0]} >= {v}" for n, v in cfg.SUCCESS_CRITERIA.items())
COUNTS = "count(*) AS n_test_samples, count(*) FILTER (WHERE era5) AS n_era5_samples, count(*) FILTER (WHERE NOT era5) AS n_real_samples"


def errors_df(spark, sf):
    return evaluation.walk_forward_errors(served_df(spark, sf), table(spark, sf, "fx_observations"), cfg.OPERATIONAL, START, END, tie_break=TB, **BT)


@query("d10_walk_forward_report", sql(f"WITH {ERRORS} SELECT {COUNTS}, {SCORES}, {MET} AS success_criteria_met FROM we", *FX))
def d10(spark, sf):
    return verify.score(errors_df(spark, sf))


@query("a10_scores_per_window", sql(f"WITH {ERRORS} SELECT window_id, {COUNTS}, {SCORES}, {MET} AS success_criteria_met FROM we GROUP BY 1", *FX))
def a10(spark, sf):
    """Means with their own denominators (A10), skill (A11), coverage (A12), decisions (A13), by source."""
    return verify.score(errors_df(spark, sf), ["window_id"])


@query("a14_scores_per_regime", sql(f"""WITH {ERRORS} SELECT regime, count(we.regime_) AS n, {', '.join(f'coalesce({r(f"avg({c})")}, 0) AS {n}' for c, n in (('cand_err', 'cand_mae_kn'), ('pers_err', 'pers_mae_kn'), ('nwp_err', 'nwp_mae_kn')))}
FROM (SELECT unnest(['breva', 'tivano', 'foehn', 'calm']) AS regime) LEFT JOIN (SELECT *, regime AS regime_ FROM we) we USING (regime) GROUP BY 1""", *FX))
def a14(spark, sf):
    return verify.regime_scores(errors_df(spark, sf))


@query("d10_window_summary", sql(f"""WITH {ERRORS}, n AS (SELECT window_id, a, count(we.point_id) AS n FROM win LEFT JOIN (SELECT point_id, window_id FROM we) we USING (window_id) GROUP BY ALL)
SELECT window_id, a AS test_start, (sum(n) OVER (ORDER BY window_id))::BIGINT AS samples FROM n""", *FX))
def d10_windows(spark, sf):
    return evaluation.window_summary(errors_df(spark, sf), crossval.walk_forward_windows(spark, START, END, **BT)).select("window_id", "test_start", "samples")


PROMOTE = """prod AS (SELECT backtest_mae_kn AS m, backtest_dir_error_deg AS d FROM fx_model_registry WHERE promoted_to_production ORDER BY trained_at DESC LIMIT 1)"""


@query("d11_promotion_gate", sql(f"""WITH {ERRORS}, {PROMOTE}, rep AS (SELECT {r('avg(cand_err)', 3)} AS mae, {r('avg(cand_dir_err)', 2)} AS dir, count(*) FILTER (WHERE NOT era5) AS n_real FROM we)
SELECT 'stub' AS candidate_name, mae AS backtest_mae_kn, dir AS backtest_dir_error_deg, {r('m - mae')} AS vs_production_mae_delta, {r('d - dir')} AS vs_production_dir_delta, n_real AS n_real_samples,
  m - mae >= 0.2 AND d - dir >= 5 AND n_real >= 50 AS promoted FROM rep CROSS JOIN prod""", *FX, "fx_model_registry"))
def d11(spark, sf):
    return verify.promotion(verify.score(errors_df(spark, sf)), table(spark, sf, "fx_model_registry"), "stub")


INDEXED = """idx AS (SELECT *, row_number() OVER (ORDER BY t, p_idx) - 1 AS i, count(*) OVER () AS n FROM (SELECT e.*, p.idx AS p_idx FROM err e JOIN fx_points p USING (point_id)))"""
COMBOS = """combos AS (SELECT row_number() OVER (ORDER BY g1, g2) - 1 AS path_id, g1, g2 FROM range(0, 6) a(g1) JOIN range(0, 6) b(g2) ON g1 < g2)"""


def indexed_df(spark, sf):
    order = table(spark, sf, "fx_points").select("point_id", F.col("idx").alias("p_order"))
    return evaluation.cross_validation_errors(served_df(spark, sf), order)


@query("d12_sample_groups", sql(f"WITH {ERRORS}, {INDEXED} SELECT point_id, t AS valid_time, i AS idx, least(i // (n // 6), 5) AS grp FROM idx", *FX))
def d12(spark, sf):
    e = indexed_df(spark, sf).select("point_id", "valid_time", "idx")
    n = e.agg(F.count("*").alias("n")).scalar()
    return e.withColumn("grp", crossval.group_of(F.col("idx"), n, GROUPS))


P, E = 2, 6
D13 = sql(f"""WITH {ERRORS}, {INDEXED}, {COMBOS}, g AS (SELECT i, least(i // (n // 6), 5) AS grp FROM idx),
test AS (SELECT path_id, i AS ti FROM combos JOIN g ON grp IN (g1, g2)),
hit AS (SELECT c.path_id, g.i, min(ti) AS ti FROM combos c JOIN g ON g.grp NOT IN (g1, g2) LEFT JOIN test t ON t.path_id = c.path_id AND ((abs(g.i - ti) <= {P}) OR (g.i > ti AND g.i - ti <= {E})) GROUP BY ALL)
SELECT path_id, count(*) FILTER (WHERE ti IS NULL) AS n_train, count(*) FILTER (WHERE abs(i - ti) <= {P}) AS n_purged, count(*) FILTER (WHERE abs(i - ti) > {P}) AS n_embargo FROM hit GROUP BY 1""", *FX)


@query("d13_purge_labels", D13)
def d13(spark, sf):
    e = indexed_df(spark, sf).select("idx")
    return crossval.label_counts(e, e.agg(F.count("*").alias("n")).scalar(), GROUPS, N_TEST, P, E)


# The same by the clock: hours from the span of a test group's times.
BY_TIME = f"""g AS (SELECT i, t, least(i // (n // 6), 5) AS grp FROM idx), span AS (SELECT grp, min(t) AS lo, max(t) AS hi FROM g GROUP BY 1),
lab AS (SELECT c.path_id, g.i, max(CASE WHEN g.t BETWEEN s.lo - INTERVAL '{P}' HOUR AND s.hi + INTERVAL '{P}' HOUR THEN 2 WHEN g.t > s.hi AND g.t <= s.hi + INTERVAL '{E}' HOUR THEN 1 ELSE 0 END) AS l
  FROM combos c JOIN g ON g.grp NOT IN (g1, g2) JOIN span s ON s.grp IN (g1, g2) GROUP BY ALL),
labels AS (SELECT path_id, count(*) FILTER (WHERE l = 0) AS n_train, count(*) FILTER (WHERE l = 2) AS n_purged, count(*) FILTER (WHERE l = 1) AS n_embargo FROM lab GROUP BY 1)"""


@query("d13_purge_by_time", sql(f"WITH {ERRORS}, {INDEXED}, {COMBOS}, {BY_TIME} SELECT * FROM labels", *FX))
def d13_time(spark, sf):
    e = indexed_df(spark, sf).select("idx", "valid_time")
    return crossval.label_counts(e, e.agg(F.count("*").alias("n")).scalar(), GROUPS, N_TEST, P, E, by_time="valid_time")


PREV = """x AS (SELECT *, least(i // (n // 6), 5) AS grp, CASE WHEN lag(point_id) OVER (ORDER BY i) = point_id THEN abs(lag(os) OVER (ORDER BY i) - os) END AS prev_err FROM idx)"""
PATHS = f"""{ERRORS}, {INDEXED}, {COMBOS}, {PREV},
pp AS (SELECT path_id, count(*) AS n_test, avg(cand_err) AS cand_mae, avg(cand_dir_err) AS cand_dir, avg(prev_err) AS pers_mae, avg(nwp_err) AS nwp_mae, avg(covered) * 100 AS interval_coverage FROM combos JOIN x ON grp IN (g1, g2) GROUP BY 1)"""


@query("a17_path_scores", sql(f"WITH {PATHS} SELECT path_id, n_test, {doubles('cand_mae cand_dir pers_mae nwp_mae interval_coverage')} FROM pp", *FX))
def a17(spark, sf):
    return evaluation.cross_validation(indexed_df(spark, sf))[0]


def mean_std(c: str, d: int) -> str:
    return f"coalesce({r(f'avg({c})', d)}, 0) AS {c}_mean, coalesce({r(f'stddev_pop({c})', d)}, 0) AS {c}_std"


D14 = sql(f"""WITH {PATHS} SELECT count(*) AS n_paths, sum(n_test)::BIGINT AS n_test_samples, {mean_std('cand_mae', 3)}, {mean_std('pers_mae', 3)}, {mean_std('nwp_mae', 3)}, {mean_std('cand_dir', 2)}, {mean_std('interval_coverage', 2)},
  {r('(1 - avg(cand_mae) / avg(nwp_mae)) * 100', 2)} AS improvement_vs_nwp_pct, coalesce({r('(1 - avg(cand_mae) / avg(pers_mae)) * 100', 2)}, 0) AS improvement_vs_persistence_pct,
  {r('avg(nwp_mae - cand_mae) / (stddev_samp(nwp_mae - cand_mae) / sqrt(count(*)))')} AS t_statistic, avg(nwp_mae - cand_mae) / (stddev_samp(nwp_mae - cand_mae) / sqrt(count(*))) > 2.144787 AS is_significant FROM pp""", *FX)


@query("d14_cross_validation", D14)
def d14(spark, sf):
    """Path means and deviations (A17) with the one-sample t-test."""
    return evaluation.cross_validation(indexed_df(spark, sf))[1]


@query("d21_validation_report", sql(f"""WITH {PAIRS} SELECT point_id, count(*) AS n_pairs, {r('avg(error)')} AS mean_error, {r('avg(abs_error) FILTER (WHERE is_reanalysis)')} AS mae_reanalysis, count(*) FILTER (WHERE is_reanalysis) AS n_reanalysis,
  {r('avg(abs_error) FILTER (WHERE NOT is_reanalysis)')} AS mae_station, count(*) FILTER (WHERE NOT is_reanalysis) AS n_station FROM pairs GROUP BY 1 HAVING count(*) >= 10""", "fx_predictions", "fx_observations"))
def d21(spark, sf):
    return verify.validation_summary(pairs_df(spark, sf))
