"""First row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank_as: str | None = None) -> DataFrame:
    """The first ``n`` rows of every key in the given order.

    The ``row_number() <= n`` filter lets Spark keep only ``n`` rows per key and task
    before the shuffle (WindowGroupLimit), so a hot key costs no more than others.
    """
    name = rank_as or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
    return kept if rank_as else kept.drop(name)


def newest_with_ties(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Rows carrying the newest time of their key; ties stay."""
    w = Window.partitionBy(*keys).orderBy(F.col(time).desc())
    return df.withColumn("_rk", F.rank().over(w)).filter("_rk = 1").drop("_rk")
