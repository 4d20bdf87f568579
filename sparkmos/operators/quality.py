"""Physical limits, required fields, optional-predicate scans, feature matrix preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.settings import PHYSICAL_LIMITS


def apply_limits(df: DataFrame, flag: str | None = "suspect", limits: dict[str, tuple[float, float]] = PHYSICAL_LIMITS) -> DataFrame:
    """NULL values outside their limits, bring directions into [0, 360).

    ``flag`` names an added column that is true when a value was removed; text columns
    are cast, and text that is no number counts as outside.
    """
    fields = {c: b for c, b in limits.items() if c in df.columns}
    bad: Column = F.lit(False)
    cleaned: dict[str, Column] = {}
    for c, (lo, hi) in fields.items():
        number = F.col(c).try_cast("double")
        ok = number.between(lo, hi)
        bad = bad | (F.col(c).isNotNull() & ~F.coalesce(ok, F.lit(False)))
        kept = F.when(ok, number)
        cleaned[c] = F.pmod(kept, F.lit(360.0)) if c == "wind_dir_deg" else kept
    if flag:
        cleaned[flag] = bad
    return df.withColumns(cleaned)


def checked_observations(df: DataFrame) -> DataFrame:
    """Limits with the row flag stored: a removed value makes the row suspect."""
    out = apply_limits(df, "_bad")
    before = F.col("quality_flag") if "quality_flag" in df.columns else F.lit("ok")
    return out.withColumn("quality_flag", F.when(F.col("_bad"), F.lit("suspect")).otherwise(before)).drop("_bad")


def with_wind(df: DataFrame) -> DataFrame:
    """Rows that carry a speed or a direction."""
    return df.filter("wind_speed_kn IS NOT NULL OR wind_dir_deg IS NOT NULL")


def scan_features(
    features: DataFrame,
    point_id: str | None = None,
    start: Column | None = None,
    end: Column | None = None,
    version: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Features under whichever of the predicates are given; the time range is closed."""
    if point_id is not None:
        features = features.filter(F.col("point_id") == point_id)
    if start is not None:
        features = features.filter(F.col("valid_time") >= start)
    if end is not None:
        features = features.filter(F.col("valid_time") <= end)
    if version is not None:
        features = features.filter(F.col("feature_set_version") == version)
    return features if limit is None else features.limit(limit)


def varying_columns(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Columns whose population variance (missing as 0) exceeds the threshold: one aggregate."""
    row = df.agg(*[F.var_pop(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in columns]).first()
    return [c for c in columns if (row[c] or 0.0) > threshold]


def prune_features(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Drop low-variance columns, but only when there are more than a fifth as many as rows."""
    if len(columns) * 5 > df.count():
        return varying_columns(df, columns, threshold)
    return list(columns)


def numeric_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Booleans to 0/1, text to numbers where it is one, everything else to double."""
    types = dict(df.dtypes)
    out = {}
    for c in columns:
        out[c] = F.col(c).cast("int").cast("double") if types[c] == "boolean" else F.col(c).try_cast("double")
    return df.withColumns(out)
