"""Backtests over one feature table: walk-forward, cross-validation, calibration.

Each backtest reads its samples several times (for errors, persistence, positions). They are
a dozen columns, so they are written once to the shared scratch folder instead of building
the features anew for every use.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions import wind
from sparkmos.operators import conformal, crossval, nearest, quantile_boost, tables, verify
from sparkmos.operators.quantile_boost import BoostParams, QuantileModel, Target
from sparkmos.plans import inference, training
from sparkmos.plans.features import training_set
from sparkmos.session import materialize
from sparkmos.settings import Point


def evaluation_samples(predicted: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with targets, seen as observed, reference and candidate wind; ``keep`` names further columns.

    ``predicted`` is a feature table after ``served_forecast``.
    """
    s, d = F.col("ref_speed_kn"), F.col("ref_dir_deg")
    ou = wind.u_of(s, d) + F.col("target_u")
    ov = wind.v_of(s, d) + F.col("target_v")
    return predicted.filter("target_u IS NOT NULL AND target_v IS NOT NULL").select(
        "point_id",
        "valid_time",
        *keep,
        wind.speed_of(ou, ov).alias("obs_speed"),
        wind.direction_of(ou, ov).alias("obs_dir"),
        "obs_source",
        s.alias("ref_speed"),
        d.alias("ref_dir"),
        F.col("wind_speed_kn").alias("cand_speed"),
        F.col("wind_dir_deg").alias("cand_dir"),
        F.col("expected_error_kn").alias("cand_error"),
        verify.score_regime(F.col("breva_window"), F.col("tivano_window"), F.col("foehn_likely")).alias("regime"),
    )


def persistence(samples: DataFrame, observations: DataFrame, points: Sequence[Point], tie_break: Sequence[str] = ()) -> DataFrame:
    """Nearest observation 30 to 120 minutes before each sample, if it has speed and direction."""
    near = tables.within(observations, "timestamp", samples, "valid_time", "INTERVAL '121' MINUTE", "INTERVAL '0' MINUTE")
    found = nearest.nearest_observation(
        samples.select("point_id", F.col("valid_time").alias("t")), near, points,
        max_age_min=120, min_age_min=30, tie_break=tie_break,
    )
    return found.filter("wind_speed_kn IS NOT NULL AND wind_dir_deg IS NOT NULL").select(
        "point_id", F.col("t").alias("valid_time"), F.col("wind_speed_kn").alias("pers_speed"),
        F.col("wind_dir_deg").alias("pers_dir"),
    )


def walk_forward_errors(
    predicted: DataFrame,
    observations: DataFrame,
    points: Sequence[Point],
    start: datetime,
    end: datetime,
    train_days: int = cfg.TRAIN_DAYS,
    test_days: int = cfg.TEST_DAYS,
    step_days: int = cfg.STEP_DAYS,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Errors of every sample, once per test window it falls into.

    Reports come from it by aggregation: ``verify.score`` overall or per window,
    ``verify.regime_scores`` per regime.
    """
    samples = materialize(evaluation_samples(predicted))
    paired = samples.join(persistence(samples, observations, points, tie_break), ["point_id", "valid_time"], "left")
    return crossval.with_windows(verify.with_errors(paired), start, end, train_days, test_days, step_days)


def window_summary(errors: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with their sample counts, cumulated in window order (a few rows)."""
    from pyspark.sql import Window

    n = errors.groupBy("window_id").agg(F.count("*").alias("n"))
    upto = Window.orderBy("window_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return windows.join(n, "window_id", "left").withColumn("samples", F.sum(F.coalesce("n", F.lit(0))).over(upto)).drop("n")


def cross_validation_errors(predicted: DataFrame, point_order: DataFrame, per_point: bool = False) -> DataFrame:
    """Indexed errors for the path scores; persistence is the sample before.

    ``point_order`` gives ``p_order`` per point.
    """
    samples = materialize(evaluation_samples(predicted).join(point_order.select("point_id", "p_order"), "point_id"))
    with_prev = verify.previous_observation(samples, ["valid_time"], per_point).withColumn("pers_dir", F.lit(None).cast("double"))
    return crossval.sample_index(verify.with_errors(with_prev))


def _predict_paths(samples: DataFrame, models: list[dict[str, QuantileModel]], combos: list[tuple[int, ...]]) -> DataFrame:
    """Every sample (with ``_grp``) once per path that tests on its group, with that path's predictions."""
    outs = list(models[0])
    names, narrow = quantile_boost.narrowed([m[o] for m in models for o in outs])
    fields = ",".join(f"{o}:double" for o in outs)

    @F.arrow_udf(f"array<struct<path_id:int,{fields}>>")
    def tested(x: pa.Array, grp: pa.Array) -> pa.Array:
        groups = grp.to_numpy(zero_copy_only=False).astype(np.int64)
        m = quantile_boost.matrix(x, len(names)) if names else np.zeros((len(groups), 0))
        rows, ids, found = [], [], []
        for i, combo in enumerate(combos):
            mine = np.flatnonzero(np.isin(groups, combo))
            rows.append(mine)
            ids.append(np.full(len(mine), i, dtype=np.int32))
            found.append(np.stack([narrow[i * len(outs) + k].score(m[mine]) for k in range(len(outs))], axis=1))
        row, values = np.concatenate(rows), np.concatenate(found)
        order = np.argsort(row, kind="stable")
        ends = np.searchsorted(row[order], np.arange(len(groups) + 1)).astype(np.int32)
        columns = [pa.array(np.concatenate(ids)[order]), *[pa.array(values[order, k]) for k in range(len(outs))]]
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=["path_id", *outs]))

    x = quantile_boost.numbers(samples, names) if names else F.array().cast("array<double>")
    each = samples.withColumn("_tested", tested(x, F.col("_grp").cast("int")))
    return each.select(*samples.columns, F.inline("_tested")).drop("_grp")


def retrained_errors(
    features: DataFrame,
    point_order: DataFrame,
    columns: Sequence[str] | None = None,
    params: BoostParams = BoostParams(),
    n_groups: int = 6,
    n_test: int = 2,
    purge: float = 2,
    embargo: float = 6,
    by_time: bool = True,
    per_point: bool = False,
    quantiles: Sequence[float] = cfg.QUANTILES,
) -> DataFrame:
    """Errors of every sample under each path that tests on it, with a model trained for that path.

    All paths share one quantised matrix and are trained together; a sample's flags say which
    paths may learn from it, so purged, embargoed and test rows stay out of a path's trees,
    leaf values and base. ``purge`` and ``embargo`` are hours (positions if not ``by_time``).
    """
    samples = training_set(features).join(point_order.select("point_id", "p_order"), "point_id")
    samples = materialize(crossval.sample_index(samples))
    n = samples.agg(F.count("*").alias("n")).scalar()
    flagged = crossval.training_flags(samples, n, n_groups, n_test, purge, embargo, "valid_time" if by_time else None, out="_use")
    columns = list(columns or training.numeric_features(training_set(features)))
    combos = crossval.paths(n_groups, n_test)
    targets = [Target(f"target_{t}", q, use=i) for i in range(len(combos)) for t in ("u", "v") for q in quantiles]
    fitted = quantile_boost.fit_models(flagged, columns, targets, ["point_id", "valid_time"], params, use="_use")
    outs = [f"bias_{t}_q{round(q * 100):02d}" for t in ("u", "v") for q in quantiles]
    models = [dict(zip(outs, fitted[i * len(outs) : (i + 1) * len(outs)])) for i in range(len(combos))]
    predicted = _predict_paths(samples.withColumn("_grp", crossval.group_of(F.col("idx"), n, n_groups)), models, combos)
    errors = evaluation_samples(inference.served_forecast(predicted), ["path_id"])
    blank = {c: F.lit(None).cast("double") for c in ("wind_speed_kn", "wind_dir_deg", "expected_error_kn")}
    observed = evaluation_samples(samples.withColumns(blank), ["p_order"]).select("point_id", "valid_time", "p_order", "obs_speed")
    before = verify.previous_observation(observed, ["valid_time"], per_point).select("point_id", "valid_time", "pers_speed")
    paired = errors.join(before, ["point_id", "valid_time"], "left").withColumn("pers_dir", F.lit(None).cast("double"))
    return verify.with_errors(paired)


def cross_validation(errors: DataFrame, n_groups: int = 6, n_test: int = 2) -> tuple[DataFrame, DataFrame]:
    """(scores per path, summary row), of one fixed model's indexed errors or of ``retrained_errors``."""
    if "path_id" in errors.columns:
        per_path = crossval.scores_by_path(errors)
    else:
        n = errors.agg(F.count("*").alias("n")).scalar()
        per_path = crossval.path_scores(errors, n, n_groups, n_test)
    return per_path, crossval.summarize_paths(per_path)


def calibrators(
    predicted: DataFrame, alpha: float = 0.1, step_hours: int = 2, quantiles: Sequence[float] = cfg.QUANTILES, normalized: str | None = None
) -> DataFrame:
    """q_hat per (target, quantile) from samples every ``step_hours``.

    The scores are written once: counts, brackets and ranks all read them, and the features
    behind them are built a single time.
    """
    every = predicted.filter(F.pmod(F.hour("valid_time"), F.lit(step_hours)) == 0)
    scores = materialize(conformal.scores_of(every, quantiles, normalized))
    return conformal.score_quantiles(scores, ["target", "quantile"], alpha)
