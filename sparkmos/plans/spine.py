"""Sample spines: points times regular or relative times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg


def hourly_spine(points: DataFrame, start: Column, end: Column, step_hours: int = 1) -> DataFrame:
    """(point_id, t) for every step of [start, end); ``p_order`` is the point's position.

    The times are exploded per point row, so the spine needs no join.
    """
    step = F.make_dt_interval(hours=F.lit(step_hours))
    last = end - F.expr("INTERVAL '0.000001' SECOND")
    return points.select("point_id", F.col("idx").alias("p_order"), F.explode(F.sequence(start, last, step)).alias("t"))


def horizon_spine(points: DataFrame, as_of: Column, horizons: Sequence[int] = cfg.HORIZONS_HOURS) -> DataFrame:
    """(point_id, t) for every horizon in hours from ``as_of``."""
    return points.select(
        "point_id", F.col("idx").alias("p_order"), F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_h")
    ).withColumn("t", as_of + F.make_dt_interval(hours=F.col("horizon_h")))
