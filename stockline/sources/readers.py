"""Readers: product exports, catalog, stored tables, order events and service logs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline import schemas
from stockline.operators.catalog import catalog_union


def read_export(spark: SparkSession, path: str, blueprint_id: int | None = None,
                expansion_id: int | None = None, multiline: bool = True) -> DataFrame:
    """Product exports under ``path/user_id=<id>/``, or in files of many sellers whose rows name theirs in ``user_id``,
    with the row's place in ``seq``: file, block of the file, row in the block. Files follow each other by name, whatever
    order Spark reads them in. Very many sellers belong in common files: a folder each takes longer than its rows.

    A JSON array per file needs ``multiline`` and is read by one task; exports of large sellers
    belong in JSON lines, which split. Filters apply only when truthy.
    """
    rows = (spark.read.schema(f"{schemas.EXPORT}, user_id string").option("multiLine", multiline)
            .json(path).withColumn("source_file", F.col("_metadata.file_path"))
            # A block is read by one task from start to end, so this number rises inside it.
            .withColumn("seq", F.struct(F.col("_metadata.file_path").alias("file"),
                                        F.col("_metadata.file_block_start").alias("block"),
                                        F.monotonically_increasing_id().alias("row"))))
    if blueprint_id:
        rows = rows.where(F.col("blueprint_id") == blueprint_id)
    if expansion_id:
        rows = rows.where(F.col("expansion_id") == expansion_id)
    return rows


def read_catalog(spark: SparkSession, path: str, needed: DataFrame | None = None) -> DataFrame:
    """The four catalog tables under ``path/<table>`` as one tagged table."""
    tables = {name: spark.read.schema(schemas.CATALOG).parquet(f"{path}/{name}")
              for name in schemas.CATALOG_TABLES}
    return catalog_union(tables, needed)


def read_catalog_jdbc(spark: SparkSession, url: str, id_column: str, properties: Mapping[str, str],
                      upper_bound: int, partitions: int = 32) -> DataFrame:
    """The same from a database, each table read in ranges of ``id_column`` by parallel tasks."""
    tables = {
        name: spark.read.jdbc(url, name, column=id_column, lowerBound=0, upperBound=upper_bound,
                              numPartitions=partitions, properties=dict(properties))
        .select(F.col("id").cast("long"), F.col(id_column).cast("int").alias("blueprint_id"))
        for name in schemas.CATALOG_TABLES}
    return catalog_union(tables)


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.INVENTORY).parquet(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.SETTINGS).parquet(path)


def read_operations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.OPERATIONS).parquet(path)


def read_order_events(spark: SparkSession, path: str, stream: bool = True,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """The event feed: JSON lines of (received_at, user_id, signature, body).

    ``body`` stays as received, since its signature covers every byte; its fields are parsed next to
    it. ``user_id`` is the seller the event was sent to, or null if only the event names one. The
    feed has no event time, so the time of receipt orders it.

    ``event_key`` tells events apart: it is the event's id, and for events without one (shown as ``unknown``) their
    place in the feed, that is file, block of the file and row. A stream can't number rows, so there a drawn name stands
    for the row; it is drawn anew if a trigger is run again, and so is all that the trigger writes.
    """
    source = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = source.schema(schemas.EVENT_ENVELOPE).json(path)
    event = F.from_json("body", schemas.ORDER_EVENT)
    row = F.uuid() if stream else F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")
    nameless = F.concat_ws(" ", F.lit("unknown"), F.col("_metadata.file_path"),
                           F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), row)
    # Selected first, so that the number of a row does not depend on what is read of it later.
    numbered = raw.select("received_at", "user_id", "signature", "body", event.alias("_event"), nameless.alias("_place"))
    return numbered.select(
        F.coalesce("_event.id", "_place").alias("event_key"), F.col("received_at").alias("ts"), "user_id", "signature", "body",
        F.coalesce("_event.id", F.lit("unknown")).alias("id"), F.coalesce("_event.cause", F.lit("")).alias("cause"),
        F.coalesce("_event.mode", F.lit("live")).alias("mode"), F.col("_event.data").alias("data"))


def read_service_logs(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON-per-line logs. Lines that are no JSON keep their text in ``corrupt_line``; ``data`` and
    other open fields stay JSON text."""
    source = spark.readStream if stream else spark.read
    return (source.schema(f"{schemas.SERVICE_LOG}, corrupt_line string")
            .option("columnNameOfCorruptRecord", "corrupt_line").json(path)
            .withColumn("logged_at", F.try_to_timestamp("timestamp")))
