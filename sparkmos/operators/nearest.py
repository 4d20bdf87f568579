"""Nearest-station lookup: the closest observation of a time interval, for fixed points.

Observations are first reduced to the newest per (place, minute), then meet the points, which
are configuration, and are reduced again to the best per (point, minute). Both reductions
begin before their shuffle, so no station, hour or point becomes a hot key; only the last
table is joined to the requests.

Requests must lie on whole minutes. ``on_mark`` separates an observation taken exactly at
the start of a minute from those later in it, so that a closed upper bound stays exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmos.functions.common import MICROS_PER_MINUTE, micros, minute_index
from sparkmos.functions.geo import haversine_km
from sparkmos.operators.keyed import first_per_key
from sparkmos.settings import Point
from sparkmos.sources.points import inline_points

PAYLOAD = ("source", "timestamp", "wind_speed_kn", "wind_dir_deg", "wind_gust_kn")


def _order(tie_break: Sequence[str]) -> list[Column]:
    """Nearest first, then newest, then by source."""
    return [F.col("dist_km"), F.col("timestamp").desc(), F.col("source"), *[F.col(c).desc() for c in tie_break]]


def best_per_minute(
    observations: DataFrame, points: Sequence[Point], payload: Sequence[str] = PAYLOAD, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The best observation per (point, minute, on_mark)."""
    cols = dict.fromkeys([*payload, "lat", "lon", *tie_break])
    # A missing coordinate counts as zero.
    place = {c: F.coalesce(c, F.lit(0.0)) for c in ("lat", "lon")}
    minute = {"o_min": minute_index("timestamp"), "on_mark": F.pmod(micros("timestamp"), F.lit(MICROS_PER_MINUTE)) == 0}
    # Readings of one place are equally far from any point: only the newest of a minute meets
    # the points. The rest of the order holds between readings of one place, too.
    obs = observations.select(*cols).withColumns({**minute, **place})
    newest = first_per_key(obs, ["lat", "lon", "o_min", "on_mark"], _order(tie_break)[1:])
    seen = newest.select("*", F.inline(inline_points(points)))
    seen = seen.withColumn("dist_km", haversine_km(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    seen = seen.drop("p_lat", "p_lon", "lat", "lon")
    best = first_per_key(seen, ["point_id", "o_min", "on_mark"], _order(tie_break))
    return best.withColumn("bucket", F.floor(F.col("o_min") / 60))


def nearest_observation(
    requests: DataFrame,
    observations: DataFrame,
    points: Sequence[Point],
    *,
    max_age_min: int,
    min_age_min: int = 0,
    payload: Sequence[str] = PAYLOAD,
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Per (point_id, t): the nearest observation with t - max_age <= timestamp <= t - min_age.

    Adds ``dist_km`` and ``age_min``. Requests without an observation give no row.
    """
    lo, hi = F.col("t_min") - max_age_min, F.col("t_min") - min_age_min
    wanted = (
        requests.select("point_id", "t")
        .distinct()
        .withColumn("t_min", minute_index("t"))
        .withColumn("bucket", F.explode(F.sequence(F.floor(lo / 60), F.floor(hi / 60))))
    )
    inside = (F.col("o_min") >= lo) & ((F.col("o_min") < hi) | ((F.col("o_min") == hi) & F.col("on_mark")))
    matched = wanted.join(best_per_minute(observations, points, payload, tie_break), ["point_id", "bucket"]).filter(inside)
    best = first_per_key(matched.repartition("point_id", "t"), ["point_id", "t"], _order(tie_break))
    return best.withColumn("age_min", (micros("t") - micros("timestamp")) / 60e6).drop(
        "bucket", "t_min", "o_min", "on_mark"
    )


def observations_before(requests: DataFrame, observations: DataFrame, max_age_min: int) -> DataFrame:
    """All observations of the look-back window of each distinct ``t``, with ``t`` attached.

    The plain lookback scan: an output of this size is what the caller asked for. Both sides
    meet in slices of a minute (of a sixtieth of the window, if that is longer), so that no
    hour of many readings is one key.
    """
    start = F.date_trunc("minute", F.col("t")).cast("timestamp_ntz") - F.make_dt_interval(mins=F.lit(max_age_min))
    slice_min = max(1, max_age_min // 60)
    at = lambda minute: F.floor(minute / slice_min)
    wanted = (
        requests.select("t")
        .distinct()
        .withColumn("_bucket", F.explode(F.sequence(at(minute_index("t") - max_age_min), at(minute_index("t")))))
    )
    obs = observations.withColumn("_bucket", at(minute_index("timestamp")))
    return wanted.join(obs, "_bucket").filter((F.col("timestamp") <= F.col("t")) & (F.col("timestamp") >= start)).drop("_bucket")


def newest_value(
    requests: DataFrame, observations: DataFrame, value: str, *, max_age_hours: int, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Newest non-NULL ``value`` of the look-back window, per distinct whole-minute ``t``.

    Readings are first reduced to the newest per minute and per hour. Whole hours inside the
    window are answered from the hourly table; only its two end hours need the minutes.
    """
    keep = dict.fromkeys(["timestamp", value, *tie_break])
    newest = [F.col("timestamp").desc(), *[F.col(c).desc() for c in tie_break]]
    readings = observations.filter(F.col(value).isNotNull()).select(*keep).withColumns(
        {
            "o_min": minute_index("timestamp"),
            "on_mark": F.pmod(micros("timestamp"), F.lit(MICROS_PER_MINUTE)) == 0,
        }
    )
    by_minute = first_per_key(readings, ["o_min", "on_mark"], newest).withColumn("o_hour", F.floor(F.col("o_min") / 60))
    by_hour = first_per_key(by_minute, ["o_hour"], newest)
    req = requests.select("t").distinct().withColumn("t_min", minute_index("t"))
    lo, hi = F.col("t_min") - max_age_hours * 60, F.col("t_min")
    first_full, last_full = F.ceil(lo / 60), F.floor(hi / 60) - 1
    full = req.withColumn("o_hour", F.explode(F.sequence(first_full, last_full))).join(by_hour, "o_hour")
    ends = (
        req.withColumn("o_hour", F.explode(F.array_distinct(F.array(F.floor(lo / 60), F.floor(hi / 60)))))
        .join(by_minute, "o_hour")
        .filter((F.col("o_min") >= lo) & ((F.col("o_min") < hi) | ((F.col("o_min") == hi) & F.col("on_mark"))))
    )
    return first_per_key(full.unionByName(ends), ["t"], newest).select("t", value)
