"""Stored Parquet tables: append, keyed upsert, insert-or-ignore, update and delete.

A change rewrites only the day partitions it touches. Because a job may not overwrite the
files it reads, the merged rows are first written to the shared scratch folder, then swapped
in with dynamic partition overwrite; a failure in between leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmos.operators.keyed import first_per_key
from sparkmos.session import materialize


def upsert(current: DataFrame, batch: DataFrame, key: Sequence[str], order: str, keep: Sequence[str] = ()) -> DataFrame:
    """``current`` with the rows of ``batch`` added or replacing those of equal key.

    Within the batch the row with the highest ``order`` wins. Columns in ``keep`` (a
    surrogate id) keep their stored value.
    """
    cols = [c for c in current.columns if c != order]
    kind = batch.schema[order].dataType
    old = current.select(*cols, F.lit(0).alias("_gen"), F.lit(None).cast(kind).alias("_order"))
    new = batch.select(*cols, F.lit(1).alias("_gen"), F.col(order).alias("_order"))
    both = old.unionByName(new)
    if keep:
        # The stored value comes from the same window as the rank: one shuffle, one sort.
        per_key = Window.partitionBy(*key)
        both = both.withColumns(
            {f"_old_{c}": F.max(F.when(F.col("_gen") == 0, F.col(c))).over(per_key) for c in keep}
        )
    winner = first_per_key(both, key, [F.col("_gen").desc(), F.col("_order").desc()])
    return winner.withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).select(*cols) if keep else winner.select(*cols)


def last_wins(batch: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The batch itself reduced to its last row per key (an upsert into an empty table)."""
    return first_per_key(batch, key, [F.col(order).desc()])


def observation_defaults(df: DataFrame) -> DataFrame:
    """Quality ``ok`` and confidence 1.0 where the batch gives none."""
    have = set(df.columns)
    return df.withColumns(
        {
            "quality_flag": F.coalesce("quality_flag", F.lit("ok")) if "quality_flag" in have else F.lit("ok"),
            "confidence": F.coalesce("confidence", F.lit(1.0)) if "confidence" in have else F.lit(1.0),
        }
    )


def insert_or_ignore(current: DataFrame, batch: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The rows of ``batch`` that are new: the first per key, unless the key is stored."""
    return first_per_key(batch, key, order).join(current.select(*key), list(key), "left_anti")


def update_from(current: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``current`` with the non-NULL columns of ``changes`` (one row per key) put in."""
    fields = [c for c in changes.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    out = current.join(new, list(key), "left")
    return out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in fields}).select(*current.columns)


def promote(registry: DataFrame, version: Column | str) -> DataFrame:
    """Make one version the production model and demote the rest."""
    v = F.lit(version) if isinstance(version, str) else version
    return registry.withColumn("promoted_to_production", F.col("model_version") == v)


def delete_owned(current: DataFrame, requests: DataFrame, key: Sequence[str]) -> DataFrame:
    """``current`` without the rows named by ``requests``; the key includes the owner."""
    return current.join(requests.select(*key), list(key), "left_anti")


def in_range(df: DataFrame, time: str, start: Column, end: Column | None, before: str, after: str = "INTERVAL '0' HOUR") -> DataFrame:
    """Rows whose time lies within the given margins of [start, end]; without ``end``, from start on.

    Stored tables are partitioned by ``day``; the same bounds on that column let the scan
    skip whole days, the bounds on the time skip row groups.
    """
    lo = start - F.expr(before)
    if end is None:
        df = df.filter(F.col(time) >= lo)
        return df.filter(F.col("day") >= lo.cast("date")) if "day" in df.columns else df
    hi = end + F.expr(after)
    df = df.filter(F.col(time).between(lo, hi))
    if "day" in df.columns:
        df = df.filter(F.col("day").between(lo.cast("date"), hi.cast("date")))
    return df


def span_of(requests: DataFrame, time: str) -> tuple[Column, Column]:
    """First and last time of ``requests``, as a scalar subquery that scans can prune by."""
    both = requests.agg(F.struct(F.min(time).alias("lo"), F.max(time).alias("hi")).alias("b")).scalar()
    return both["lo"], both["hi"]


def within(df: DataFrame, time: str, requests: DataFrame, request_time: str, before: str, after: str) -> DataFrame:
    """Rows of ``df`` that lie within the given margins of any time asked for."""
    return in_range(df, time, *span_of(requests, request_time), before, after)


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def upsert_path(
    spark: SparkSession, path: str, batch: DataFrame, key: Sequence[str], order: str, day_of: str, keep: Sequence[str] = ()
) -> None:
    """Upsert into a Parquet table partitioned by ``day`` = date of ``day_of``.

    ``day_of`` is part of the key, so a row never moves to another partition. The batch's
    distinct days go into the scan of the table as a list, so that only these partitions are
    read and rewritten. Writing the same batch again changes nothing.
    """
    batch = materialize(batch.withColumn("day", F.to_date(day_of)))
    if not _exists(spark, path):
        last_wins(batch, key, order).drop(order).write.partitionBy("day").parquet(path)
        return
    current = spark.read.parquet(path)
    # One date per day of the batch: as many as partitions are rewritten anyway.
    days = [r["day"] for r in batch.select("day").distinct().collect()]
    old = current.filter(F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() & F.lit(None in days)))
    merged = materialize(upsert(old, batch, key, order, keep))
    merged.select(*current.columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "day"
    ).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
