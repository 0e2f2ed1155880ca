"""Running a stream to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append everything that is available to parquet files, then stop."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Write each trigger's changed rows to a folder of its own; a repeated trigger overwrites it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def latest_updates(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key out of ``run_updates``."""
    rows = spark.read.parquet(path)
    payload = [c for c in rows.columns if c not in (*keys, "batch")]
    return (rows.groupBy(*keys).agg(F.max_by(F.struct(*payload), "batch").alias("_last"))
            .select(*keys, "_last.*"))
