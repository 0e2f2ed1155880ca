"""Bulk synchronisation of product exports into the inventory, for all sellers at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.operators import products as p
from stockline.operators.catalog import map_to_catalog
from stockline.operators.scan import Running, number_slice, running

ITEM_KEY = ["user_id", "blueprint_id", "external_stock_id"]
PARALLEL_CHUNKS = 3
_COUNTED = ["created", "updated", "skipped"]


def prepare_products(export: DataFrame) -> DataFrame:
    """Valid rows with their stock id, defaults filled in, one row per item."""
    rows = p.with_defaults(p.valid_products(export)).withColumn("external_stock_id", F.col("id").cast("string"))
    return p.last_write(rows, ITEM_KEY)


def match_inventory(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add ``item_id``: the inventory row with the same seller, blueprint and stock id, or null."""
    keys = (inventory.where(F.col("external_stock_id").isNotNull())
            .select(*ITEM_KEY, F.col("id").alias("item_id")))
    return products.join(keys, ITEM_KEY, "left")


def classify_export(export: DataFrame, resolved: DataFrame, inventory: DataFrame,
                    excluded: Sequence[str] = p.EXCLUDED_SOURCES) -> DataFrame:
    """One row per product with its ``outcome``: created, updated or one of three skips."""
    # Matched first: the rows already lie by item, as the last one of each was looked for.
    matched = map_to_catalog(match_inventory(prepare_products(export), inventory), resolved)
    outcome = (F.when(F.col("table_name").isNull(), "skip_unmapped")
               .when(F.col("table_name").isin(list(excluded)), "skip_excluded")
               .when(F.col("item_id").isNotNull(), "updated").otherwise("created"))
    columns = [*export.columns, "outcome"]
    invalid = p.invalid_products(export).withColumn("outcome", F.lit("skip_invalid"))
    return matched.withColumn("outcome", outcome).select(columns).unionByName(invalid.select(columns))


def bulk_sync(export: DataFrame, resolved: DataFrame, inventory: DataFrame, now: Column,
              excluded: Sequence[str] = p.EXCLUDED_SOURCES) -> DataFrame:
    """The inventory after the import.

    Known items get quantity, price, properties and ``updated_at``; new items keep the source
    blueprint id and have no description, user data or grading (and no id yet, see
    ``assign_ids``). Items that the export does not name stay as they are.
    """
    changes = p.exclude_sources(map_to_catalog(prepare_products(export), resolved), excluded).select(
        *ITEM_KEY, F.col("quantity").alias("new_quantity"), F.col("price_cents").alias("new_price"),
        F.col("properties_hash").alias("new_properties"), F.lit(True).alias("_changed"))
    linked = inventory.where(F.col("external_stock_id").isNotNull())
    # Rows without a stock id match nothing; as null join keys they would share one partition.
    unlinked = inventory.where(F.col("external_stock_id").isNull())
    changed = F.col("_changed").isNotNull()
    inserted = F.col("_known").isNull()
    merged = linked.withColumn("_known", F.lit(True)).join(changes, ITEM_KEY, "full").select(
        "id", "user_id", "blueprint_id",
        F.when(changed, F.col("new_quantity")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(changed, F.col("new_price")).otherwise(F.col("price_cents")).alias("price_cents"),
        F.when(changed, F.col("new_properties")).otherwise(F.col("properties")).alias("properties"),
        "external_stock_id", "description", "user_data_field", "graded",
        F.when(inserted, now).otherwise(F.col("created_at")).alias("created_at"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"))
    return merged.unionByName(unlinked.select(merged.columns))


def merge_outcomes(outcomes: DataFrame, inventory: DataFrame, now: Column, first_id: int) -> DataFrame:
    """The inventory after an import whose products are classified already (``classify_export``): what ``bulk_sync``
    gives, with new items numbered from ``first_id`` on. Nothing is prepared, mapped or matched again: updated products
    join their items, created ones are added."""
    stock_id = F.col("id").cast("string").alias("external_stock_id")
    changes = outcomes.where(F.col("outcome") == "updated").select(
        "user_id", "blueprint_id", stock_id, F.col("quantity").alias("_quantity"), F.col("price_cents").alias("_price"),
        F.col("properties_hash").alias("_properties"), F.lit(True).alias("_changed")).dropDuplicates(ITEM_KEY)
    linked = inventory.where(F.col("external_stock_id").isNotNull())
    # Rows without a stock id match nothing; as null join keys they would share one partition.
    unlinked = inventory.where(F.col("external_stock_id").isNull())
    changed = F.col("_changed").isNotNull()
    known = linked.join(changes, ITEM_KEY, "left").withColumns({
        "quantity": F.when(changed, F.col("_quantity")).otherwise(F.col("quantity")),
        "price_cents": F.when(changed, F.col("_price")).otherwise(F.col("price_cents")),
        "properties": F.when(changed, F.col("_properties")).otherwise(F.col("properties")),
        "updated_at": F.when(changed, now).otherwise(F.col("updated_at"))}).select(*inventory.columns)
    kinds = {f.name: f.dataType for f in inventory.schema.fields}
    created = outcomes.where(F.col("outcome") == "created").select(
        F.lit(None).cast("long").alias("id"), "user_id", F.col("blueprint_id").cast(kinds["blueprint_id"]).alias("blueprint_id"),
        stock_id, "quantity", "price_cents", F.col("properties_hash").alias("properties"),
        *[F.lit(None).cast(kinds[c]).alias(c) for c in ("description", "user_data_field", "graded")],
        now.alias("created_at"), now.alias("updated_at"))
    return known.unionByName(unlinked).unionByName(assign_ids(created, first_id).select(inventory.columns))


def assign_ids(inventory: DataFrame, start: int, buckets: int = 4096) -> DataFrame:
    """Give rows without an id the numbers from ``start`` on: dense, and the same on every run."""
    fresh = inventory.where(F.col("id").isNull()).drop("id")
    numbered = running(fresh, [], ITEM_KEY, F.pmod(F.hash(*ITEM_KEY), F.lit(buckets)),
                       {"id": Running("sum", F.lit(1).cast("long"))})
    return (inventory.where(F.col("id").isNotNull())
            .unionByName(numbered.withColumn("id", F.col("id") + F.lit(start - 1))))


def _outcome_counts() -> list[Column]:
    outcome = F.col("outcome")
    return [
        F.count(F.lit(1)).alias("processed"),
        F.count_if(outcome == "created").alias("created"),
        F.count_if(outcome == "updated").alias("updated"),
        F.count_if(outcome.startswith("skip")).alias("skipped"),
    ]


def sync_summary(outcomes: DataFrame) -> DataFrame:
    """Totals per seller; processed = created + updated + skipped."""
    return outcomes.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_products"), *_outcome_counts())


def chunk_summary(chunked_outcomes: DataFrame) -> DataFrame:
    """The same counts per seller and chunk (input: outcomes with a ``chunk`` column)."""
    return chunked_outcomes.groupBy("user_id", "chunk").agg(*_outcome_counts())


def sync_progress(chunks: DataFrame, parallel: int = PARALLEL_CHUNKS) -> DataFrame:
    """Progress record after every batch of ``parallel`` chunks, counts cumulated per seller."""
    batches = (chunks.withColumn("batch", F.floor(F.col("chunk") / F.lit(parallel)))
               .groupBy("user_id", "batch")
               .agg(F.count(F.lit(1)).alias("_chunks"), F.sum("processed").alias("_processed"),
                    *[F.sum(c).alias(f"_{c}") for c in _COUNTED]))
    so_far = running(
        batches, ["user_id"], ["batch"], number_slice(F.col("batch"), 100_000),
        {"processed_chunks": Running("sum", F.col("_chunks")),
         "processed": Running("sum", F.col("_processed")),
         **{c: Running("sum", F.col(f"_{c}")) for c in _COUNTED}})
    totals = chunks.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_chunks"),
                                           F.sum("processed").alias("total_products"))
    done = F.col("processed_chunks").cast("double") / F.col("total_chunks").cast("double")
    return so_far.join(totals, "user_id").select(
        "user_id", "batch", "total_products", "total_chunks", "processed_chunks",
        (done * 100).cast("int").alias("progress_percent"), "processed", *_COUNTED)
