"""A19, D15, the remaining verification entries and the learned ones (D4, D6, L6, A27, D14 trained anew) against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.featureset import OP_SPINE, OWN, features_df, ref
from checks.fx import query, r, sql, table
from checks.lookups import PAIRS, nearest_sql, pairs_df
from checks.alerting import FRESH, PENALTY, fresh_now
from checks.scoring import BY_TIME, COMBOS, CONF, FX, GROUPS, N_TEST, PATHS, SERVED, indexed_df, served_df, stubbed
from sparkmos import settings as cfg
from sparkmos.operators import attribution, conformal, crossval, health, quantile_boost, verify
from sparkmos.plans import evaluation, features, inference, training
from sparkmos.session import materialize

#: Numeric columns of the feature row with climatology.
N_FEATURES = 190

SCORES = """sc AS (SELECT CASE WHEN id % 2 = 0 THEN 'u' ELSE 'v' END AS target, CASE id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.5 ELSE 0.9 END::DOUBLE AS quantile, abs(wind_speed_kn - expected_error_kn) AS score FROM fx_predictions)"""
# Position level * (n - 1) between two order statistics.
POSITION = "max(score) FILTER (WHERE i = floor(pos)) + (max(score) FILTER (WHERE i = ceil(pos)) - max(score) FILTER (WHERE i = floor(pos))) * (pos - floor(pos))"
Q_HAT = f"""lv AS (SELECT target, quantile, count(*) AS n, least(ceil((count(*) + 1) * 0.9::DOUBLE) / count(*), 1) * (count(*) - 1) AS pos FROM sc GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY target, quantile ORDER BY score) - 1 AS i FROM sc)
SELECT target, quantile, n AS n_calibration, {r(POSITION)} AS q_hat
FROM rk JOIN lv USING (target, quantile) WHERE n >= 100 GROUP BY target, quantile, n, pos"""


@query("a19_conformal_quantile", sql(f"WITH {SCORES}, {Q_HAT}", "fx_predictions"))
def a19(spark, sf):
    s = table(spark, sf, "fx_predictions").selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'u' ELSE 'v' END AS target", "CASE id % 3 WHEN 0 THEN 0.1D WHEN 1 THEN 0.5D ELSE 0.9D END AS quantile",
        "abs(wind_speed_kn - expected_error_kn) AS score",
    )
    return conformal.score_quantiles(s, ["target", "quantile"])


TARGET = "CASE '{t}' WHEN 'u' THEN -o_speed * sin(radians(o_dir)) + fc_icon_eu_speed * sin(radians(fc_icon_eu_dir)) ELSE -o_speed * cos(radians(o_dir)) + fc_icon_eu_speed * cos(radians(fc_icon_eu_dir)) END"
D15 = sql(f"""WITH {SERVED}, sc AS (SELECT * FROM ({' UNION ALL '.join(f"SELECT '{t}' AS target, {q}::DOUBLE AS quantile, abs({TARGET.format(t=t)} - bias_{t}_q{round(q * 100):02d}) AS score FROM served WHERE hour(t) % 2 = 0" for t in ('u', 'v') for q in cfg.QUANTILES)}) WHERE score IS NOT NULL), {Q_HAT}""", *FX)


@query("d15_conformal_calibrators", D15)
def d15(spark, sf):
    return evaluation.calibrators(served_df(spark, sf))


# Calibrated by scores in units of the expected error, with stale sources taken off the confidence.
UNITS = "CASE WHEN {e} >= 0.1 THEN {e} / 0.1 ELSE 1 END"
NORMED = "sc AS (SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS target, {q}::DOUBLE AS quantile, abs({TARGET.format(t=t)} - bias_{t}_q{round(q * 100):02d}) / {UNITS.format(e='expected_error_kn')} AS score FROM served WHERE hour(t) % 2 = 0" for t in ("u", "v") for q in cfg.QUANTILES
) + ") WHERE score IS NOT NULL)"
SHIFTED = ", ".join(
    r(f"bias_{t}_q{n:02d} {'-' if n < 50 else '+'} coalesce((SELECT q_hat FROM qh WHERE target = '{t}' AND quantile = {q}::DOUBLE), 0) * {UNITS.format(e='err')}") + f" AS bias_{t}_q{n:02d}" for t in ("u", "v") for q, n in ((0.1, 10), (0.9, 90))
)
D5_CALIBRATED = sql(f"""WITH {SERVED}, {NORMED}, {Q_HAT.replace(chr(10) + 'SELECT', ', qh AS (SELECT').replace(r(POSITION), POSITION)}), {FRESH}, pen AS ({PENALTY})
SELECT point_id, t AS valid_time, wind_speed_kn, wind_gust_kn, {r(f'({CONF}) * (1 - (SELECT penalty FROM pen))', 1)} AS confidence_pct, {SHIFTED} FROM served""", *FX, "fx_source_health")


@query("d05_served_calibrated", D5_CALIBRATED)
def d05_calibrated(spark, sf):
    """All features, normalized calibrators, and the freshness penalty of the sources."""
    rows = stubbed(features_df(spark, sf))
    q_hats = evaluation.calibrators(served_df(spark, sf), normalized="expected_error_kn")
    status = health.freshness(table(spark, sf, "fx_source_health"), fresh_now())
    penalty = health.freshness_penalty(status).select("penalty").scalar()
    served = inference.served_forecast(rows, calibrators=q_hats, freshness_penalty=penalty)
    return served.select("point_id", "valid_time", "wind_speed_kn", "wind_gust_kn", "confidence_pct", *[f"bias_{t}_q{n}" for t in ("u", "v") for n in ("10", "90")])


@query("a11_skill", sql(f"WITH {PAIRS} SELECT point_id, {r('CASE WHEN avg(abs(wind_gust_kn - obs_speed)) > 0 THEN (1 - avg(abs_error) / avg(abs(wind_gust_kn - obs_speed))) * 100 ELSE 0 END')} AS skill_pct FROM pairs GROUP BY 1", "fx_predictions", "fx_observations"))
def a11(spark, sf):
    """Against the gust taken for the wind."""
    g = pairs_df(spark, sf).groupBy("point_id").agg(F.avg("abs_error").alias("c"), F.avg(F.abs(F.col("wind_gust_kn") - F.col("obs_speed"))).alias("b"))
    return g.select("point_id", verify.skill_pct(F.col("c"), F.col("b")).alias("skill_pct"))


def scored(spark, sf):
    p = pairs_df(spark, sf).select(
        "point_id", "valid_time", "obs_speed", "obs_dir", "obs_source", F.col("wind_speed_kn").alias("cand_speed"), F.col("wind_dir_deg").alias("cand_dir"),
        F.col("expected_error_kn").alias("cand_error"), F.col("wind_gust_kn").alias("ref_speed"), F.col("wind_dir_deg").alias("ref_dir"),
        F.col("wind_gust_kn").alias("pers_speed"), F.col("wind_dir_deg").alias("pers_dir"),
    )
    return verify.with_errors(p)


COVER = "obs_speed BETWEEN greatest(0, wind_speed_kn - expected_error_kn) AND wind_speed_kn + expected_error_kn"


@query("a12_interval_coverage", sql(f"WITH {PAIRS} SELECT point_id, {r(f'avg(({COVER})::INT)')} AS coverage FROM pairs GROUP BY 1", "fx_predictions", "fx_observations"))
def a12(spark, sf):
    return scored(spark, sf).groupBy("point_id").agg(F.avg("covered").alias("coverage"))


@query("a13_decision_hits", sql(f"""WITH {PAIRS} SELECT point_id, {r('avg(((wind_speed_kn >= 8) = (obs_speed >= 8))::INT)')} AS hit_rate, count(*) AS n FROM pairs
WHERE hour(valid_time AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Rome') BETWEEN 11 AND 16 GROUP BY 1""", "fx_predictions", "fx_observations"))
def a13(spark, sf):
    return scored(spark, sf).groupBy("point_id").agg(F.avg("hit").alias("hit_rate"), F.count("hit").alias("n"))


@query("a15_scores_by_source", sql(f"""WITH {PAIRS} SELECT obs_source = 'era5_reanalysis' AS is_reanalysis, count(*) AS n, {r('avg(abs_error)')} AS cand_mae, {r('avg(abs(wind_gust_kn - obs_speed))')} AS nwp_mae FROM pairs GROUP BY 1""", "fx_predictions", "fx_observations"))
def a15(spark, sf):
    return scored(spark, sf).groupBy("is_reanalysis").agg(F.count("*").alias("n"), F.avg("cand_err").alias("cand_mae"), F.avg("nwp_err").alias("nwp_mae"))


@query("a18_t_test", sql(f"""WITH {PAIRS}, g AS (SELECT point_id, avg(abs(wind_gust_kn - obs_speed)) - avg(abs_error) AS d FROM pairs GROUP BY 1)
SELECT count(*) AS n, {r('avg(d) / (stddev_samp(d) / sqrt(count(*)))')} AS t_statistic, avg(d) / (stddev_samp(d) / sqrt(count(*))) > 2.228139 AS is_significant FROM g""", "fx_predictions", "fx_observations"))
def a18(spark, sf):
    """The points' means take the place of the paths' (11 of them, ten degrees of freedom)."""
    g = scored(spark, sf).groupBy("point_id").agg(
        F.count("*").alias("n_test"), *[F.avg(c).alias(m) for m, c in crossval.METRICS.items()]
    )
    return crossval.summarize_paths(g).select(F.col("n_paths").alias("n"), "t_statistic", "is_significant")


@query("j15_path_membership", sql(f"""WITH {COMBOS}, n AS (SELECT count(*) AS n FROM fx_predictions), i AS (SELECT id, valid_time, row_number() OVER (ORDER BY valid_time, id) - 1 AS i FROM fx_predictions)
SELECT id, path_id FROM i CROSS JOIN n JOIN combos ON least(i // (n // 6), 5) IN (g1, g2)""", "fx_predictions"))
def j15(spark, sf):
    p = table(spark, sf, "fx_predictions").select("id", "valid_time", F.col("id").alias("p_order"))
    n = p.agg(F.count("*").alias("n")).scalar()
    grp = crossval.group_of(F.col("idx"), n, GROUPS)
    table_ = crossval.paths_of_group(GROUPS, N_TEST)
    return crossval.sample_index(p).select("id", F.explode(F.get(table_, grp.cast("int"))).alias("path_id"))


# --- Learned results. Trees and their sums have tests of their own; here counts are exact, and
# --- what must hold whatever the trees are is asserted per row.

TRAINED = f"""WITH {OP_SPINE}, {OWN}, {nearest_sql(0, 60)}, tr AS (SELECT w.point_id, w.t FROM wide w JOIN near USING (point_id, t) WHERE {ref('speed')} IS NOT NULL AND {ref('dir')} IS NOT NULL AND near.wind_speed_kn IS NOT NULL AND near.wind_dir_deg IS NOT NULL)"""


def training_df(spark, sf):
    """All features, climatology included, of every sample with an observation."""
    return materialize(features.training_set(features_df(spark, sf)))


@query("d04_quantile_model", sql(f"{TRAINED} SELECT point_id, count(*) AS n, {', '.join(f'TRUE AS {t}_q{round(q * 100):02d}_better' for t in ('u', 'v') for q in cfg.QUANTILES)} FROM tr WHERE (SELECT count(*) FROM tr) >= 200 GROUP BY 1", *FX))
def d04(spark, sf):
    """Six models over all features: samples per point, and whether each quantile's loss there is below the best constant's."""
    f = training_df(spark, sf)
    model = training.train(f)
    if model is None:
        return f.groupBy("point_id").agg(F.count("*").alias("n"), *[F.lit(True).alias(f"{t}_q{round(q * 100):02d}_better") for t in ("u", "v") for q in cfg.QUANTILES]).limit(0)
    losses = []
    for (t, q), m in model.models.items():
        y, name = F.col(f"target_{t}"), f"{t}_q{round(q * 100):02d}"
        loss = lambda p: F.sum(quantile_boost.pinball(y, p, q))  # noqa: B023, E731
        losses.append((loss(F.col(f"bias_{name}")) < loss(F.lit(m.base))).alias(f"{name}_better"))
    return model.predict(f).groupBy("point_id").agg(F.count("*").alias("n"), *losses)


@query("d06_contributions", sql(f"{TRAINED} SELECT point_id, count(*) AS n, TRUE AS at_most_five, TRUE AS by_size, TRUE AS adds_up FROM tr WHERE (SELECT count(*) FROM tr) >= 200 GROUP BY 1", *FX))
def d06(spark, sf):
    """The five features that moved each sample's prediction most (L6), held against the rules they must keep."""
    f = training_df(spark, sf)
    if f.count() < cfg.MIN_TRAIN_SAMPLES:
        return f.groupBy("point_id").agg(F.count("*").alias("n"), *[F.lit(True).alias(c) for c in ("at_most_five", "by_size", "adds_up")]).limit(0)
    model = quantile_boost.fit_quantile(f, training.numeric_features(f), "target_u", 0.5, ["point_id", "valid_time"])
    told = model.predict(attribution.explain(f, model), "bias")
    start = attribution.expected(model)
    size = F.transform("top_contributors", lambda c: F.abs(c["value"]))
    total = F.aggregate(F.map_values("contributions"), F.lit(start), lambda a, v: a + v)
    return told.groupBy("point_id").agg(
        F.count("*").alias("n"), F.bool_and(F.size("top_contributors") <= 5).alias("at_most_five"),
        F.bool_and(size == F.reverse(F.array_sort(size))).alias("by_size"), F.bool_and(F.abs(total - F.col("bias")) < 1e-6).alias("adds_up"),
    )


@query("a27_feature_discovery", sql(f"{TRAINED} SELECT count(*) AS n, count(*) >= 100 AS enough, CASE WHEN count(*) >= 100 THEN {N_FEATURES} ELSE 0 END AS n_ranked, count(*) >= 100 AS some_selected, TRUE AS at_most_fifty FROM tr", *FX))
def a27(spark, sf):
    """All features ranked behind the gate of 100 samples."""
    f = training_df(spark, sf)
    names = training.numeric_features(f)
    ranked = quantile_boost.ranked_features(f, names)
    selected = [c for c, share, _ in ranked[:50] if share > 0.001]
    n = f.agg(F.count("*").alias("n"))
    return n.select("n", (F.col("n") >= quantile_boost.MIN_DISCOVERY).alias("enough"), F.lit(len(ranked)).alias("n_ranked"), F.lit(bool(selected)).alias("some_selected"), F.lit(len(selected) <= 50).alias("at_most_fifty"))


@query("a27_feature_ranking")
def a27_ranking(spark, sf):
    """Share of a boosted median model's gain, and a single split's gain, per feature."""
    f = training_df(spark, sf)
    ranked = quantile_boost.ranked_features(f, training.numeric_features(f))
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ranked, 1)], "rank int, feature string, share double, first_gain double")


# 15 paths of six models each.
PATH_PARAMS = quantile_boost.BoostParams(rounds=10, max_depth=4)


@query("d14_cross_validation_retrained", sql(f"WITH {PATHS}, {BY_TIME} SELECT path_id, n_test, n_train, TRUE AS own_model FROM pp JOIN labels USING (path_id)", *FX))
def d14_retrained(spark, sf):
    """Scores of models trained anew for every path; they differ from those of the one fixed candidate."""
    order = table(spark, sf, "fx_points").select("point_id", F.col("idx").alias("p_order"))
    own = evaluation.cross_validation(evaluation.retrained_errors(features_df(spark, sf), order, params=PATH_PARAMS))[0]
    fixed = materialize(indexed_df(spark, sf))
    n = fixed.agg(F.count("*").alias("n")).scalar()
    labels = crossval.label_counts(fixed, n, GROUPS, N_TEST, 2, 6, by_time="valid_time")
    before = evaluation.cross_validation(fixed)[0].select("path_id", F.col("cand_mae").alias("fixed_mae"))
    differs = F.abs(F.col("cand_mae") - F.col("fixed_mae")) > 1e-6
    return own.join(labels, "path_id").join(before, "path_id").select("path_id", "n_test", "n_train", differs.alias("own_model"))
