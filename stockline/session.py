"""Session settings the jobs expect, and where they may put intermediate data."""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Left joins from a hot key are split even if that costs one more exchange later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    # A JSON object that repeats a key counts with the last one and does not stop the job.
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    # A job is many queries: what one has shuffled is removed at its end and does not lie there until the last has ended.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # A few hundred folders of buckets are listed by as many tasks else, several times a job.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "32",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# What one task reads of a table, and what shuffled pieces are put together for one task: a row of the formats takes ten
# times its compressed size while it is sorted or grouped, and the defaults (128 and 64 MB) then take gigabytes a task.
# Values that the session was given are left alone.
SIZES = {
    "spark.sql.files.maxPartitionBytes": ("134217728b", "32m"),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m"),
}


def build_session(app_name: str = "stockline", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    configure(spark)
    return spark


def configure(spark: SparkSession) -> None:
    """Bring a session that was built elsewhere to the settings the jobs expect.

    The few Python functions that run in tasks travel by value, so executors need no copy of this
    package.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for key, (default, value) in SIZES.items():
        if spark.conf.get(key) == default:
            spark.conf.set(key, value)
    import stockline

    cloudpickle.register_pickle_by_value(stockline)


def stream_session(spark: SparkSession, state_partitions: int | None = None) -> SparkSession:
    """A session for stateful streams.

    The number of state partitions is fixed for the life of a checkpoint and each one is a store of
    its own, so it follows the cluster's cores and not the batch setting.
    """
    session = spark.newSession()
    configure(session)
    session.conf.set("spark.sql.shuffle.partitions",
                     str(state_partitions or spark.sparkContext.defaultParallelism))
    # Rows leave the trigger that takes them, so a trigger without data would only walk through the state. Stores that
    # count their keys look each one up once more.
    session.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    # A trigger's changes of the state are written once, not as whole files of the store beside its own.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    return session


_folder: str | None = None


def use_shared_folder(path: str | None) -> None:
    """Name the folder for intermediate tables of sessions that do not set ``spark.checkpoint.dir``."""
    global _folder
    _folder = path


def provide_shared_folder(spark: SparkSession) -> None:
    """For entry points, tests and benchmarks: a folder of their own if a one-process session names none."""
    if not _folder and not spark.conf.get("spark.checkpoint.dir", None):
        master = spark.sparkContext.master
        if master == "local" or master.startswith("local["):
            use_shared_folder(f"/tmp/checkpoints/stockline-{uuid.uuid4().hex}")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or _folder
    if not root:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(frame: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table once and read it back, where several branches need it."""
    path = scratch_path(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
