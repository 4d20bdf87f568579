"""From features and predicted bias to the served forecast."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.functions import decision, wind
from sparkmos.functions.common import rnd
from sparkmos.plans.features import REF

QUANTILE_COLUMNS = [f"bias_{t}_q{round(q * 100):02d}" for t in ("u", "v") for q in cfg.QUANTILES]


def calibrate(df: DataFrame, calibrators: DataFrame, error: Column, quantiles: Sequence[float] = cfg.QUANTILES) -> DataFrame:
    """Shift the outer bias quantiles by the calibrators' q_hat; missing calibrators change nothing.

    Calibrators are one row per (target, quantile); they are folded into a single map.
    """
    entries = F.map_from_entries(
        F.collect_list(F.struct(F.concat_ws("|", "target", F.col("quantile").cast("string")), "q_hat"))
    )
    q_hats = calibrators.agg(entries.alias("m")).scalar()
    shifted = {
        f"bias_{t}_q{round(q * 100):02d}": decision.conformal_shift(
            F.col(f"bias_{t}_q{round(q * 100):02d}"), F.try_element_at(q_hats, F.lit(f"{t}|{q}")), F.lit(q), error
        )
        for t in ("u", "v")
        for q in quantiles
    }
    return df.withColumns(shifted)


def expected_error() -> Column:
    return decision.expected_error(
        F.col("bias_u_q10"), F.col("bias_u_q90"), F.col("bias_v_q10"), F.col("bias_v_q90")
    )


def served_forecast(
    df: DataFrame,
    *,
    calibrators: DataFrame | None = None,
    freshness_penalty: Column | None = None,
    count_ensembles: bool = False,
    reference: str = REF,
) -> DataFrame:
    """Corrected wind, gust, confidence and error columns for rows with bias quantiles.

    ``freshness_penalty`` (0 to 0.5) lowers the confidence by that share;
    ``count_ensembles`` lets ensemble rows stand in for missing models.
    """
    df = df.withColumn("_err", expected_error())
    if calibrators is not None:
        df = calibrate(df, calibrators, F.col("_err"))
    s, d = F.col("ref_speed_kn"), F.col("ref_dir_deg")
    fu, fv = wind.u_of(s, d), wind.v_of(s, d)
    bu, bv = F.col("bias_u_q50"), F.col("bias_v_q50")
    df = df.withColumns(
        {"_speed": wind.corrected_speed(fu, fv, bu, bv), "_dir": wind.corrected_direction(fu, fv, bu, bv)}
    )
    conf = decision.confidence(
        F.col("_err"), F.col("obs_nearest_missing"), F.col("n_rows" if count_ensembles else "n_models")
    )
    if freshness_penalty is not None:
        conf = conf * (1.0 - freshness_penalty)
    gust = decision.gust_from_ratio(F.col(f"fc_{reference}_gust"), s, F.col("_speed"))
    return df.withColumns(
        {
            "wind_speed_kn": rnd(F.col("_speed"), 2),
            "wind_dir_deg": rnd(F.col("_dir"), 1),
            "wind_gust_kn": rnd(gust, 2),
            "confidence_pct": rnd(conf, 1),
            "expected_error_kn": rnd(F.col("_err"), 2),
            "quantiles_cross": decision.quantiles_cross(*[F.col(c) for c in QUANTILE_COLUMNS[:3]])
            | decision.quantiles_cross(*[F.col(c) for c in QUANTILE_COLUMNS[3:]]),
        }
    ).drop("_err", "_speed", "_dir")


def prediction_rows(served: DataFrame, generated_at: Column, version: Column | str) -> DataFrame:
    """Rows for the ``predictions`` table."""
    v = F.lit(version) if isinstance(version, str) else version
    return served.select(
        F.xxhash64("point_id", "valid_time", generated_at, v).alias("id"),
        "point_id",
        generated_at.alias("generated_at"),
        "valid_time",
        v.alias("model_version"),
        "wind_speed_kn", "wind_dir_deg", "wind_gust_kn", "confidence_pct", "expected_error_kn",
    )
