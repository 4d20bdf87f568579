"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Times are zone-less UTC throughout; casts between zone-less and zoned
# timestamps must therefore be the identity.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # The JVM does not compile methods above 8000 bytes of bytecode. A wide feature stage
    # fused into one method exceeds that and would be interpreted; Spark then does better
    # with one compiled projection per step.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows of texts are long: what Python workers and the JVM hold of them follows this.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # Streaming state on the executors' disks, not in their memory; the stateful rules need it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options this library needs on an existing session."""
    for key, value in REQUIRED.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build(app: str = "sparkmos", master: str | None = None, **conf: str) -> SparkSession:
    # Recording the Python call site of every column expression costs more than planning
    # does for a plan with thousands of them.
    builder = SparkSession.builder.appName(app).config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.host", "127.0.0.1").config(
                "spark.driver.bindAddress", "127.0.0.1"
            )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


@functools.lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="sparkmos-")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names a folder every executor can reach; without one a cluster session
    cannot go on. In local mode, where driver and executors share one disk, a temporary
    folder of this process stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root()
    return os.path.join(root, uuid.uuid4().hex) if "://" not in root else f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Used where a result feeds several jobs: it cuts lineage, survives the loss of
    executors and lets each reader prune columns.
    """
    path = scratch_dir(df.sparkSession)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
