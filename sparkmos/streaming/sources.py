"""File streams and the helpers every streaming query here uses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sparkmos.operators import quality
from sparkmos.session import scratch_dir


def file_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None, files_per_batch: int | None = None,
    bytes_per_batch: int = 1024**3, fmt: str = "parquet",
) -> DataFrame:
    """Files of a folder as a stream, in micro-batches of bounded size.

    The bound is for memory only: no result depends on it.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.load(path)


def with_event_time(df: DataFrame, time: str, delay: str, name: str = "event_time") -> DataFrame:
    """A zoned event-time column with its watermark (watermarks need a zoned timestamp)."""
    return df.withColumn(name, F.col(time).cast("timestamp")).withWatermark(name, delay)


def drop_future(df: DataFrame, time: str, as_of: Column, slack_minutes: int = 60) -> DataFrame:
    """Rows more than ``slack_minutes`` ahead of now are wrong clocks."""
    return df.filter(F.col(time) <= as_of + F.make_dt_interval(mins=F.lit(slack_minutes)))


def clean_observations(df: DataFrame) -> DataFrame:
    """The batch quality rules, unchanged: they are plain column expressions."""
    return quality.with_wind(quality.checked_observations(df))


def run_available(df: DataFrame, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Process everything that has arrived, in as many micro-batches as it takes, then stop.

    With ``sink`` every micro-batch goes to that function, otherwise to Parquet at ``path``.
    A scheduler can call this again with the same checkpoint to go on from where it stopped.
    """
    writer = df.writeStream.outputMode(mode).trigger(availableNow=True)
    writer = writer.option("checkpointLocation", checkpoint or scratch_dir(df.sparkSession))
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").start(path)
    query.awaitTermination()
    return query
