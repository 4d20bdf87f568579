"""De-duplication, upsert sink, windowed statistics, sessions and joins on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkmos.operators.keyed import first_per_key
from sparkmos.operators.tables import upsert_path
from sparkmos.streaming.sources import with_event_time


def deduplicate(df: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """First row per key; keys are remembered only as long as the watermark allows."""
    return with_event_time(df, time, delay).dropDuplicatesWithinWatermark(list(keys)).drop("event_time")


def upsert_sink(spark: SparkSession, path: str, key: Sequence[str], day_of: str, order: str | None = None) -> Callable[[DataFrame, int], None]:
    """Sink that upserts each micro-batch; a batch that is retried changes nothing.

    ``order`` decides between rows of one batch; later batches always win.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        ranked = batch.withColumn("_seq", F.col(order) if order else F.lit(0))
        upsert_path(spark, path, ranked, key, "_seq", day_of)

    return write


def source_statistics(df: DataFrame, time: str, delay: str, size: str = "1 hour", slide: str | None = None, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Count, mean speed and newest reading per source and (tumbling or sliding) window."""
    w = F.window("event_time", size, slide) if slide else F.window("event_time", size)
    g = with_event_time(df, time, delay).groupBy(w.alias("w"), *keys).agg(
        F.count("*").alias("n"), F.avg("wind_speed_kn").alias("mean_speed"), F.max(time).alias("newest")
    )
    return g.select(
        *keys, F.col("w.start").cast("timestamp_ntz").alias("window_start"), F.col("w.end").cast("timestamp_ntz").alias("window_end"),
        "n", "mean_speed", "newest",
    )


def staleness(statistics: DataFrame, as_of: Column, sla: Column) -> DataFrame:
    """Minutes since the newest reading of each source, against its allowance."""
    from sparkmos.functions.decision import age_minutes

    newest = statistics.groupBy("source").agg(F.max("newest").alias("newest"))
    age = age_minutes(as_of, F.col("newest"))
    return newest.select("source", "newest", age.alias("age_minutes"), sla.alias("sla_minutes"), (age <= sla).alias("is_fresh"))


def windy_sessions(df: DataFrame, time: str, delay: str, gap: str, threshold: float, keys: Sequence[str] = ("source",)) -> DataFrame:
    """Sessions of readings at or above the threshold, closed by a gap without such readings."""
    windy = with_event_time(df.filter(F.col("wind_speed_kn") >= threshold), time, delay)
    g = windy.groupBy(F.session_window("event_time", gap).alias("w"), *keys).agg(
        F.count("*").alias("n"), F.min("wind_speed_kn").alias("min_speed"), F.max("wind_speed_kn").alias("max_speed")
    )
    return g.select(
        *keys, F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"),
        "n", "min_speed", "max_speed",
    )


def enrich(stream: DataFrame, static: DataFrame, on: str) -> DataFrame:
    """Stream-static join; the static side is a small dimension and read anew per micro-batch."""
    return stream.join(static, on)


EDGES = "o_time timestamp, id bigint, source string, obs_speed double"


class MinuteEdges(StatefulProcessor):
    """Of each minute, the rows that are its first or last so far; two sort keys of state per minute."""

    #: In order of time, and against it; of equal times the first source, then the newest id.
    ORDERS = {"first": 1, "last": -1}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = {name: handle.getValueState(name, "us bigint, source string, id bigint") for name in self.ORDERS}

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple] = {}
        for batch in rows:
            for name, way in self.ORDERS.items():
                top = batch.assign(_t=way * batch["us"], _s=batch["source"].fillna(""), _i=-batch["id"]).sort_values(["_t", "_s", "_i"]).iloc[0]
                rank = (int(top["_t"]), top["_s"], int(top["_i"]))
                if name not in found or rank < found[name][0]:
                    found[name] = (rank, top)
        out = {}
        for name, (rank, row) in found.items():
            state = self.best[name]
            old = tuple(state.get()) if state.exists() else None
            if old is None or rank < old:
                state.update(rank)
                out[int(row["id"]), rank[0] * self.ORDERS[name]] = row
            if old is None and name == "first":
                self.handle.registerTimer((int(key[0]) + 1) * 60_000)
        if out:
            yield pd.DataFrame([r[["o_time", "id", "source", "obs_speed"]] for r in out.values()])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in self.best.values():
            if state.exists():
                state.clear()
        return iter(())


def minute_edges(observations: DataFrame, delay: str) -> DataFrame:
    """The stream's first and last row of every minute, as far as each micro-batch knows them."""
    obs = observations.select(
        F.col("timestamp").cast("timestamp").alias("o_time"), F.col("id").cast("bigint").alias("id"), "source", F.col("wind_speed_kn").cast("double").alias("obs_speed")
    ).withWatermark("o_time", delay)
    us = F.unix_micros("o_time")
    keyed = obs.withColumns({"us": us, "minute": F.floor(us / 60_000_000)})
    return keyed.groupBy("minute").transformWithStateInPandas(MinuteEdges(), EDGES, "Append", "EventTime", eventTimeColumnName="o_time")


def nearest_pairs(predictions: DataFrame, observations: DataFrame, delay: str) -> DataFrame:
    """Observations within an hour of each distinct valid time, as a stream-stream join.

    Valid times lie on whole minutes (others fail the query), so only the first and the last
    observation of a minute can be nearest to one: no more than these enter the join's state,
    two per minute and micro-batch, however many readings an hour has. Both sides carry
    watermarks and the time bound is part of the condition, so old state is dropped. An hour
    bucket gives the join its equality. The nearest one is chosen by ``nearest_sink`` and
    ``nearest_of``, since it may arrive in another micro-batch.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / 3600)
    valid = F.col("valid_time").cast("timestamp")
    on_minute = F.pmod(F.unix_micros(valid), F.lit(60_000_000)) == 0
    times = (
        predictions.select(F.when(on_minute, valid).otherwise(F.raise_error(F.lit("a valid time is not on a whole minute")).cast("timestamp")).alias("v_time"))
        .withWatermark("v_time", delay)
        .dropDuplicatesWithinWatermark(["v_time"])
        .withColumn("bucket", F.explode(F.sequence(hour(F.col("v_time")) - 1, hour(F.col("v_time")) + 1)))
    )
    obs = minute_edges(observations, delay).withColumn("o_bucket", hour(F.col("o_time")))
    return times.join(
        obs,
        F.expr("bucket = o_bucket AND o_time >= v_time - INTERVAL '1' HOUR AND o_time <= v_time + INTERVAL '1' HOUR"),
    ).select(
        F.col("v_time").cast("timestamp_ntz").alias("valid_time"), F.col("o_time").cast("timestamp_ntz").alias("obs_time"),
        "id", "source", "obs_speed",
    )


def _nearest(pairs: DataFrame) -> DataFrame:
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    diff = F.abs(us("obs_time") - us("valid_time"))
    return first_per_key(pairs, ["valid_time"], [diff, F.col("obs_time").desc(), F.col("source"), F.col("id").desc()])


def nearest_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Keep each micro-batch's nearest pair per valid time, in a folder of its own."""

    def write(batch: DataFrame, batch_id: int) -> None:
        _nearest(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def nearest_of(spark: SparkSession, path: str) -> DataFrame:
    """The nearest pair over all micro-batches so far."""
    return _nearest(spark.read.parquet(path).drop("batch"))
