"""Learned parts: better than a constant, repeatable, stored and explained faithfully."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkmos.operators import attribution, conformal, quantile_boost as qb
from sparkmos.plans import inference, training

FEATURES = ["x", "z", "up"]
PARAMS = qb.BoostParams(rounds=8, learning_rate=0.3, max_depth=4, min_leaf=10, checkpoint_every=3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x, z = rng.uniform(-3, 3, n), rng.uniform(0, 1, n)
    y = np.sin(x) * 3 + rng.normal(0, 0.3 + z, n)
    rows = [(i, float(x[i]), None if i % 10 == 0 else float(z[i]), bool(x[i] > 0), float(y[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id bigint, x double, z double, up boolean, y double")
    return df.filter("id < 2000"), df.filter("id >= 2000")


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_pinball_loss_beats_the_constant(data, q):
    train, held = data
    model = qb.fit_quantile(train, FEATURES, "y", q, ["id"], PARAMS)
    out = model.predict(held, "p")
    loss, base = out.agg(F.avg(qb.pinball(F.col("y"), F.col("p"), q)), F.avg(qb.pinball(F.col("y"), F.lit(model.base), q))).first()
    below = out.agg(F.avg((F.col("y") <= F.col("p")).cast("double"))).first()[0]
    assert loss < 0.75 * base and abs(below - q) < 0.08


def loop_fit(x, y, h, q, params, use=None):
    """The same boosting in one process: full rows, plain loops over features and cuts."""
    state = qb._State([qb.Target("y", q)], ["y"], x.shape[1], params.max_bins, params, [[]])
    mine = np.ones(len(y), dtype=bool) if use is None else use
    rank = lambda v: np.sort(v)[max(0, int(np.ceil(q * len(v))) - 1)]
    pred = np.full(len(y), rank(y[mine]))
    cuts = [sorted({np.sort(c[~np.isnan(c)])[max(0, int(np.ceil(i / (params.max_bins - 1) * (~np.isnan(c)).sum())) - 1)] for i in range(1, params.max_bins - 1)}) for c in x.T]
    for turn in range(params.rounds):
        rows = mine & state.rows_of(0, h, None, turn)
        g = np.where(y < pred, q - 1, q)
        leaves = [(rows, np.ones(len(y), dtype=bool), 0)]
        done = []
        while leaves:
            learn, here, depth = leaves.pop()
            best = None
            n = (learn & here).sum()
            if depth < params.max_depth and n >= 2 * params.min_leaf:
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        for missing_left in (False, True):
                            left = here & np.where(np.isnan(x[:, f]), missing_left, x[:, f] <= c)
                            a, b = learn & left, learn & here & ~left
                            if min(a.sum(), b.sum()) < params.min_leaf:
                                continue
                            gain = g[a].sum() ** 2 / a.sum() + g[b].sum() ** 2 / b.sum() - g[learn & here].sum() ** 2 / n
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, left)
            if best is None or best[0] <= 1e-9:
                done.append(here)
            else:
                leaves += [(learn, here & best[1], depth + 1), (learn, here & ~best[1], depth + 1)]
        step = np.zeros(len(y))
        for here in done:
            step[here] = rank((y - pred)[rows & here]) if (rows & here).any() else 0.0
        pred = pred + params.learning_rate * step
    return pred


@pytest.mark.parametrize("held_bytes", [qb.HELD, 1])
def test_trees_equal_a_loop_over_all_cuts(spark, data, monkeypatch, held_bytes):
    """Two labels and two quantiles together, one of them on part of the rows, in one pass or one per model."""
    monkeypatch.setattr(qb, "HELD", held_bytes)
    params = qb.BoostParams(rounds=5, learning_rate=0.3, max_depth=3, min_leaf=25, max_bins=12, checkpoint_every=2)
    train = data[0].where("id < 700").withColumn("w", -2 * F.col("y")).withColumn("part", F.array(F.col("id") % 3 != 0, F.lit(True))).repartition(3)
    targets = [qb.Target("y", 0.5), qb.Target("w", 0.9), qb.Target("y", 0.1, use=0), qb.Target("y", 0.5, use=1)]
    models = qb.fit_models(train, FEATURES, targets, ["id"], params, use="part")
    rows = train.withColumn("h", F.xxhash64("id")).toPandas().sort_values("id")
    x = rows[FEATURES].astype(float).to_numpy()
    for t, m in zip(targets, models):
        want = loop_fit(x, rows[t.label].to_numpy(), rows.h.to_numpy(), t.quantile, params, (rows.id % 3 != 0).to_numpy() if t.use == 0 else None)
        assert m.score(x) == pytest.approx(want, abs=1e-9)
    assert all(len(t.feature) > 1 for m in models for t in m.trees)


def test_each_path_has_a_model_of_its_own_training_rows(spark):
    """Path scores equal those of models that are fitted one by one on the path's training rows."""
    from datetime import datetime, timedelta

    from sparkmos.operators import crossval, verify
    from sparkmos.plans import evaluation
    from sparkmos.session import materialize

    rng = np.random.default_rng(3)
    rows = []
    for h in range(90):
        for p in range(3):
            a, b = rng.normal(), rng.normal()
            rows.append((f"p{p}", datetime(2024, 1, 1) + timedelta(hours=h), p, a, b, 3 * a + h / 30 + rng.normal() / 5, -2 * b + rng.normal() / 5, 10.0, 200.0, 12.0))
    df = spark.createDataFrame(rows, "point_id string, valid_time timestamp_ntz, p int, a double, b double, target_u double, target_v double, ref_speed_kn double, ref_dir_deg double, fc_icon_eu_gust double")
    df = materialize(df.selectExpr("*", "'s' AS obs_source", "false AS breva_window", "false AS tivano_window", "false AS foehn_likely", "5L AS n_models", "5L AS n_rows", "false AS obs_nearest_missing"))
    order = df.select("point_id", F.col("p").alias("p_order")).distinct()
    small = qb.BoostParams(rounds=3, max_depth=2, min_leaf=10, checkpoint_every=2)
    errors = evaluation.retrained_errors(df.drop("p"), order, ["a", "b"], small, n_groups=4, n_test=2, purge=2, embargo=5)
    got = {r.path_id: r for r in evaluation.cross_validation(errors)[0].collect()}
    indexed = crossval.sample_index(df.join(order, "point_id"))
    labels = materialize(crossval.training_labels(indexed, 270, 4, 2, 2, 5, by_time="valid_time"))
    cuts = qb.cut_points
    for path, combo in enumerate(crossval.paths(4, 2)):
        if path not in (0, 3):
            continue
        train = labels.where(f"path_id = {path} AND label = 'train'")
        fixed = cuts(df, ["a", "b"], small.max_bins)  # the paths share their bins
        qb.cut_points = lambda *_: fixed
        try:
            model = qb.fit_bias(train, ["a", "b"], [0.1, 0.5, 0.9], ["point_id", "valid_time"], small)
        finally:
            qb.cut_points = cuts
        test = indexed.where(crossval.group_of(F.col("idx"), 270, 4).isin(*combo))
        served = inference.served_forecast(model.predict(test))
        e = verify.with_errors(evaluation.evaluation_samples(served).withColumns({"pers_speed": F.lit(None).cast("double"), "pers_dir": F.lit(None).cast("double")}))
        want = e.agg(F.count("cand_err").alias("n"), F.avg("cand_err").alias("mae"), F.avg("covered") * 100).first()
        assert (got[path].n_test, got[path].cand_mae, got[path].interval_coverage) == pytest.approx(tuple(want))
    assert len(got) == 6 and len({round(r.cand_mae, 9) for r in got.values()}) == 6


def test_missing_values_have_a_side_of_their_own(spark):
    rows = [(i, None if i % 4 == 0 else float(i % 10), (50.0 if i % 4 == 0 else 0.0) + i / 1000) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    model = qb.fit_quantile(df, ["x"], "y", 0.5, ["id"], qb.BoostParams(rounds=1, learning_rate=1.0, max_depth=2))
    got = model.predict(df.withColumn("x", F.when(F.col("id") % 8 == 0, float("nan")).otherwise(F.col("x"))), "p")
    assert got.where("abs(p - y) > 1").count() == 0


def test_fit_is_repeatable_and_survives_storage(spark, data, tmp_path):
    train, held = data
    train = train.withColumns({"target_u": F.col("y"), "target_v": -F.col("y")})
    small = qb.BoostParams(rounds=2, max_depth=3)
    a = qb.fit_bias(train, FEATURES, [0.1, 0.9], ["id"], small)
    b = qb.fit_bias(train.repartition(3), FEATURES, [0.1, 0.9], ["id"], small)
    a.save(spark, str(tmp_path / "m"))
    c = qb.BiasModel.load(spark, str(tmp_path / "m"))
    cols = ["id", "bias_u_q10", "bias_v_q90"]
    first = a.predict(held).select(*cols).orderBy("id").collect()
    assert first == c.predict(held).select(*cols).orderBy("id").collect()
    assert first == b.predict(held).select(*cols).orderBy("id").collect()


def by_subsets(model, row):
    """Shapley values by enumeration of all sets of known features."""
    from itertools import combinations
    from math import factorial

    def value(tree, node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        sides = tree.left[node], tree.right[node]
        if f in known:
            left = tree.missing_left[node] if np.isnan(row[f]) else row[f] <= tree.threshold[node]
            return value(tree, sides[0 if left else 1], known)
        return sum(tree.cover[s] * value(tree, s, known) for s in sides) / tree.cover[node]

    n = len(row)
    out = []
    for j in range(n):
        others = [k for k in range(n) if k != j]
        total = 0.0
        for size in range(n):
            for s in combinations(others, size):
                w = factorial(size) * factorial(n - size - 1) / factorial(n)
                total += w * sum(value(t, 0, {*s, j}) - value(t, 0, set(s)) for t in model.trees)
        out.append(model.learning_rate * total)
    return out


def test_contributions_equal_the_sum_over_subsets(spark, data):
    train, held = data
    wide = train.withColumns({"a": F.col("x") * F.col("x"), "b": F.col("id") % 7})
    names = [*FEATURES, "a", "b"]
    model = qb.fit_quantile(wide, names, "y", 0.5, ["id"], qb.BoostParams(rounds=3, max_depth=4, min_leaf=10))
    out = attribution.explain(held.withColumns({"a": F.col("x") * F.col("x"), "b": F.col("id") % 7}), model)
    out = model.predict(out, "p").orderBy("id").limit(40).collect()
    start = attribution.expected(model)
    for r in out:
        x = [np.nan if r[c] is None else float(r[c]) for c in names]
        want = dict(zip(names, by_subsets(model, x)))
        assert r.contributions == pytest.approx({c: v for c, v in want.items() if c in r.contributions}, abs=1e-9)
        assert all(abs(v) < 1e-12 for c, v in want.items() if c not in r.contributions)
        assert r.p == pytest.approx(start + sum(r.contributions.values()), abs=1e-9)
        sizes = [abs(c.value) for c in r.top_contributors]
        assert sizes == sorted(sizes, reverse=True) and len(sizes) <= 5 and r.top_contributors[0].feature in ("x", "up", "a")


def test_conformal_quantile_equals_numpy_and_covers(spark):
    rng = np.random.default_rng(1)
    cal, fresh = np.abs(rng.normal(0, 1, 700)), np.abs(rng.normal(0, 1, 5000))
    cal[:50] = cal[50]  # ties
    rows = [("u", 0.1, float(v)) for v in cal] + [("v", 0.9, float(v)) for v in cal[:99]] + [("v", 0.5, 2.0)] * 150
    df = spark.createDataFrame(rows, "target string, quantile double, score double")
    got = {(r.target, r.quantile): r for r in conformal.score_quantiles(df, ["target", "quantile"], 0.1).collect()}
    assert set(got) == {("u", 0.1), ("v", 0.5)}  # 99 scores are too few
    want = np.quantile(cal, min(np.ceil(701 * 0.9) / 700, 1))
    assert got["u", 0.1].q_hat == pytest.approx(want) and got["v", 0.5].q_hat == 2.0
    assert np.mean(fresh <= got["u", 0.1].q_hat) >= 0.9 - 0.03


def test_quantiles_of_many_groups_and_of_a_large_one(spark):
    """3,000 small groups, one larger than the sketch with ties and gaps: the exact interpolated order statistic."""
    rng = np.random.default_rng(5)
    small = [(f"g{i % 3000}", float(rng.integers(0, 40)) / 7) for i in range(36_000)]
    big = [("big", float(v)) for v in np.concatenate([rng.exponential(1, 20_000), np.full(9_000, 2.25), rng.exponential(1, 3_001) + 3])]
    rows = small + big + [("none", None)] * 200
    df = spark.createDataFrame(rows, "g string, score double").repartition(4)
    got = {r.g: r for r in conformal.score_quantiles(df, ["g"], 0.1, min_n=10).collect()}
    values = {}
    for g, v in rows:
        if v is not None:
            values.setdefault(g, []).append(v)
    assert set(got) == {g for g, v in values.items() if len(v) >= 10}
    for g, v in values.items():
        n = len(v)
        assert got[g].n_calibration == n and got[g].q_hat == pytest.approx(np.quantile(v, min(np.ceil((n + 1) * 0.9) / n, 1)), abs=1e-12)


def test_calibration_widens_the_interval_only(spark):
    df = spark.createDataFrame([(-1.0, 0.0, 1.0, -1.0, 0.0, 1.0, 0.2)], "bias_u_q10 double, bias_u_q50 double, bias_u_q90 double, bias_v_q10 double, bias_v_q50 double, bias_v_q90 double, e double")
    cal = spark.createDataFrame([("u", 0.1, 0.5), ("u", 0.5, 9.0), ("v", 0.9, 0.25)], "target string, quantile double, q_hat double")
    r = inference.calibrate(df, cal, F.col("e")).first()
    assert list(r)[:6] == [-2.0, 0.0, 1.0, -1.0, 0.0, 1.5]


def test_too_few_samples_give_no_model(spark):
    df = spark.createDataFrame([("p", i, 1.0, 1.0, 1.0) for i in range(50)], "point_id string, valid_time int, x double, target_u double, target_v double")
    assert training.train(df, ["x"]) is None


def test_feature_discovery_ranks_every_feature(data):
    train, _ = data
    noisy = train.withColumns({"noise": F.rand(1), "same": F.lit(1.0)})
    options = dict(label="y", keys=["id"], params=qb.BoostParams(rounds=3, max_depth=3))
    ranked = qb.ranked_features(noisy, ["noise", "x", "z", "same"], **options)
    assert [r[0] for r in ranked][0] == "x" and len(ranked) == 4 and sum(r[1] for r in ranked) == pytest.approx(1)
    assert ranked[-1] == ("same", 0.0, 0.0) and dict((c, g) for c, _, g in ranked)["x"] > 10 * dict((c, g) for c, _, g in ranked)["noise"]
    assert "same" not in qb.discover_features(noisy, ["noise", "x", "z", "same"], **options)
    assert qb.ranked_features(noisy.where("id < 99"), ["x"], **options) == []  # too few samples
