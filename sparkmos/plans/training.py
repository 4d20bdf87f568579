"""Fit the bias model on a training set and describe it for the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg
from sparkmos.operators import quality
from sparkmos.operators.quantile_boost import BiasModel, BoostParams, fit_bias
from sparkmos.plans.features import feature_columns, training_set
from sparkmos.session import materialize


def numeric_features(df: DataFrame) -> list[str]:
    numeric = ("int", "bigint", "double", "float", "boolean", "smallint", "tinyint")
    types = dict(df.dtypes)
    return [c for c in feature_columns(df) if types[c] in numeric]


def train(features: DataFrame, columns: Sequence[str] | None = None, params: BoostParams = BoostParams(), quantiles: Sequence[float] = cfg.QUANTILES) -> BiasModel | None:
    """Fit all quantiles, or None below the minimum number of samples.

    Low-variance columns go first when there are many columns for the rows.
    """
    data = materialize(training_set(features))
    if data.count() < cfg.MIN_TRAIN_SAMPLES:
        return None
    kept = quality.prune_features(data, list(columns or numeric_features(data)))
    return fit_bias(data, kept, quantiles, ["point_id", "valid_time"], params)


def registry_row(spark_df: DataFrame, version: str, trained_at: Column, start: Column, end: Column, mae: Column, notes: str = "") -> DataFrame:
    """One row for the model registry, from a single-row frame of metrics."""
    return spark_df.select(
        F.lit(version).alias("model_version"),
        trained_at.alias("trained_at"),
        F.lit("v1").alias("feature_set_version"),
        start.cast("date").alias("training_period_start"),
        end.cast("date").alias("training_period_end"),
        mae.alias("backtest_mae_kn"),
        F.lit(None).cast("double").alias("backtest_dir_error_deg"),
        F.lit(False).alias("promoted_to_production"),
        F.lit("").alias("git_commit"),
        F.lit(notes).alias("notes"),
    )
