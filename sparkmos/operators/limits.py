"""Rate limits and cool-downs over a keyed event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def commands_last_hour(events: DataFrame, key: str, time: str) -> DataFrame:
    """Events of the same key in the hour up to each event, itself included.

    The whole range is cut into hours per key, so that the window of a busy key is not sorted
    in one task: an hour needs its own events and those of the hour before, which are handed
    on as copies and dropped after counting.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    both = events.withColumns({"_us": us, "_home": F.floor(us / HOUR_US)}).withColumn("_hour", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
    w = Window.partitionBy(key, "_hour").orderBy("_us").rangeBetween(-HOUR_US, Window.currentRow)
    return both.withColumn("n_last_hour", F.count("*").over(w)).filter("_hour = _home").drop("_us", "_home", "_hour")
