"""Work tables for collectors: which date ranges to fetch for which point and model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos import settings as cfg


def days(n: int) -> Column:
    return F.make_dt_interval(days=F.lit(n))


def chunks(df: DataFrame, start: str, end: str, chunk_days: int, gap_days: int = 0) -> DataFrame:
    """Split [start, end) of every row into chunks of at most ``chunk_days``.

    The next chunk starts where the last one ended, plus ``gap_days`` (the deep variant
    steps one day on).
    """
    step = days(chunk_days + gap_days)
    starts = F.when(
        F.col(start) < F.col(end),
        F.sequence(F.col(start), F.col(end) - F.expr("INTERVAL '0.000001' SECOND"), step),
    )
    return df.withColumn("chunk_start", F.explode(starts)).withColumn(
        "chunk_end", F.least(F.col("chunk_start") + days(chunk_days), F.col(end))
    )


def forecast_tasks(ranges: DataFrame, models: Sequence[str] = cfg.MODELS, chunk_days: int = 90) -> DataFrame:
    """(point_id, start, end) rows to one row per model and chunk."""
    per_model = ranges.withColumn("model_name", F.explode(F.array(*[F.lit(m) for m in models])))
    return chunks(per_model, "start", "end", chunk_days)


def incremental_ranges(points: DataFrame, stored: DataFrame, as_of: Column, default_days: int = 3 * 365) -> DataFrame:
    """Per point: from one hour after the newest stored time (or ``default_days`` ago) to now."""
    newest = stored.groupBy("point_id").agg(F.max("timestamp").alias("last_ts"))
    return (
        points.select("point_id")
        .join(newest, "point_id", "left")
        .withColumns(
            {
                "start": F.coalesce(F.col("last_ts") + F.expr("INTERVAL '1' HOUR"), as_of - days(default_days)),
                "end": as_of,
            }
        )
        .filter(F.col("start") < F.col("end"))
    )
