"""Forecast lookup: for (point, time, window) the newest run of every model.

A band join on the point alone would compare every request with every forecast of that
point. Both sides therefore carry an hour bucket: forecasts have one, requests are
exploded over the few buckets their window touches, and the band becomes a residual of an
equi-join on (point, bucket).

Before the join, forecasts are reduced to the newest run per (point, model, valid minute).
The band only looks at the valid minute, so this loses nothing, and no (point, bucket) key
can then hold more than 60 rows per model, however many runs were stored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.functions.common import minute_index
from sparkmos.operators.keyed import first_per_key


def newest_runs(forecasts: DataFrame, columns: Sequence[str], tie_break: Sequence[str] = ()) -> DataFrame:
    """Newest run per (point, model, valid minute), with its minute and hour bucket."""
    wanted = dict.fromkeys(["point_id", "model_name", "run_time", "valid_time", *columns, *tie_break])
    df = forecasts.select(*wanted).withColumn("v_min", minute_index("valid_time"))
    order = [F.col("run_time").desc(), F.col("valid_time"), *[F.col(c).desc() for c in tie_break]]
    return first_per_key(df, ["point_id", "model_name", "v_min"], order).withColumn(
        "bucket", F.floor(F.col("v_min") / 60)
    )


def forecasts_at(
    requests: DataFrame,
    forecasts: DataFrame,
    columns: Sequence[str],
    window_minutes: int,
    *,
    causal: bool = False,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Newest run per model for each distinct (point_id, t) within ``window_minutes``.

    Times are compared as whole minutes. Of one run, the valid time nearest to ``t`` wins,
    then the earlier one. ``causal`` looks only at valid times up to ``t``.
    """
    t_min = F.col("t_min")
    hi = t_min if causal else t_min + window_minutes
    wanted = (
        requests.select("point_id", "t")
        .distinct()
        .withColumn("t_min", minute_index("t"))
        .withColumn("bucket", F.explode(F.sequence(F.floor((t_min - window_minutes) / 60), F.floor(hi / 60))))
    )
    runs = newest_runs(forecasts, columns, tie_break)
    diff = F.col("v_min") - F.col("t_min")
    in_band = diff.between(-window_minutes, 0 if causal else window_minutes)
    matched = wanted.join(runs, ["point_id", "bucket"]).filter(in_band)
    order = [F.col("run_time").desc(), F.abs(diff), F.col("valid_time"), *[F.col(c).desc() for c in tie_break]]
    # One exchange on (point, t) serves this ranking and whatever groups by sample next.
    spread = matched.repartition("point_id", "t")
    return first_per_key(spread, ["point_id", "t", "model_name"], order).drop("bucket", "t_min", "v_min")


def reference_first(model: Column, reference: str) -> list[Column]:
    """Order that prefers the reference model, then model name."""
    return [(model != reference).cast("int"), model]


def reference_forecast(
    requests: DataFrame,
    forecasts: DataFrame,
    columns: Sequence[str],
    window_minutes: int,
    reference: str,
    **options,
) -> DataFrame:
    """One forecast per (point_id, t): the reference model's, else the first by name."""
    found = forecasts_at(requests, forecasts, columns, window_minutes, **options)
    return first_per_key(found, ["point_id", "t"], reference_first(F.col("model_name"), reference))


def nearest_in_time(
    requests: DataFrame,
    rows: DataFrame,
    *,
    keys: Sequence[str],
    request_time: str,
    row_time: str,
    tolerance_s: int,
    request_id: Sequence[str],
    tie_break: Sequence[Column],
    strict: bool = False,
) -> DataFrame:
    """The row nearest in time to each request, within a tolerance, per equal ``keys``.

    Hour buckets turn the band into an equi-join; the group limit keeps one candidate per
    request and task before anything is shuffled for the ranking.
    """
    from sparkmos.functions.common import micros

    us = tolerance_s * 1_000_000
    hour = 3_600_000_000
    req = requests.withColumn("_t", micros(request_time)).withColumn(
        "_bucket", F.explode(F.sequence(F.floor((F.col("_t") - us) / hour), F.floor((F.col("_t") + us) / hour)))
    )
    cand = rows.withColumn("_v", micros(row_time)).withColumn("_bucket", F.floor(F.col("_v") / hour))
    dist = F.abs(F.col("_v") - F.col("_t"))
    near = dist < us if strict else dist <= us
    matched = req.join(cand, [*keys, "_bucket"]).filter(near).withColumn("diff_s", dist / 1e6)
    best = first_per_key(matched, list(request_id), [F.col("diff_s"), *tie_break])
    return best.drop("_t", "_v", "_bucket")
