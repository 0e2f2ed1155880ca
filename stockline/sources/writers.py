"""Writers: outbound change records and old tables brought to a new schema. Inventory versions are written by
``snapshots``, whose functions stand here, too."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.operators.scan import number_slice, numbered
from stockline.sources.snapshots import VersionTaken, current_version, last_id, read_snapshot, write_inventory

BATCH_SIZE = 100
PRICE = "price_cents"

__all__ = ["VersionTaken", "batch_outbox", "create_outbox", "current_version", "delete_outbox", "evolve_schema",
           "increment_outbox", "last_id", "read_snapshot", "update_outbox", "write_inventory", "write_outbox"]


def write_outbox(records: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write one run's outbound records (columns of the record's header and a JSON ``body``) as JSON
    lines to a folder of their own, which a repeated run overwrites.

    Not partitioned by seller unless asked for: millions of sellers would mean millions of folders.
    """
    writer = records.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.json(path)


def update_outbox(payloads: DataFrame) -> DataFrame:
    """Queued update records out of ``edits.build_update_payload``."""
    return payloads.where(F.col("status") == "queued").select("user_id", "item_id", "body")


def delete_outbox(deleted: DataFrame) -> DataFrame:
    """Outbound deletes of the removed items that have a stock id; one that is no number is an error."""
    product = F.expr("try_cast(external_stock_id as bigint)")
    return deleted.where(F.coalesce(F.col("external_stock_id") != "", F.lit(False))).select(
        "user_id", F.col("id").alias("item_id"), product.alias("product_id"),
        F.when(product.isNull(), F.concat(F.lit("not a product id: "), F.col("external_stock_id"))).alias("error"))


def increment_outbox(moves: DataFrame) -> DataFrame:
    """Outbound quantity changes (user_id, external_stock_id, remote_quantity, delta); nothing left
    means delete."""
    gone = F.col("remote_quantity") + F.col("delta") <= 0
    return moves.select(
        "user_id", F.expr("try_cast(external_stock_id as bigint)").alias("product_id"),
        F.when(gone, "delete").otherwise("increment").alias("action"),
        F.when(~gone, F.to_json(F.struct(F.col("delta").alias("delta_quantity")))).alias("body"))


def create_outbox(items: DataFrame) -> DataFrame:
    """Records for products that are new to the marketplace."""
    body = F.struct("blueprint_id", (F.col(PRICE) / F.lit(100.0)).alias("price"), "quantity", "description",
                    "user_data_field", "graded")
    return items.select("user_id", F.col("id").alias("item_id"), F.to_json(body).alias("body"))


def batch_outbox(records: DataFrame, size: int = BATCH_SIZE) -> DataFrame:
    """Number a seller's records by item id and pack them into batches of ``size``."""
    placed = numbered(records, ["user_id"], ["item_id"], number_slice(F.col("item_id")))
    entry = F.struct("item_id", "body")
    return (placed.withColumn("batch", F.floor((F.col("position") - 1) / F.lit(size)))
            .groupBy("user_id", "batch")
            .agg(F.count(F.lit(1)).alias("records"), F.array_sort(F.collect_list(entry)).alias("products")))


def evolve_schema(frame: DataFrame, target_schema: str) -> DataFrame:
    """Bring an old table to the target schema: missing columns become null; ``metadata`` is renamed
    to ``operation_metadata`` where the target has only the latter."""
    target = frame.sparkSession.createDataFrame([], target_schema)
    if "operation_metadata" in target.columns and "operation_metadata" not in frame.columns \
            and "metadata" in frame.columns:
        frame = frame.withColumnRenamed("metadata", "operation_metadata")
    known = [c for c in target.columns if c in frame.columns]
    return target.unionByName(frame.select(*known), allowMissingColumns=True)
