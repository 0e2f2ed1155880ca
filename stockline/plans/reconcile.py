"""Reconciliation of the inventory with the remote export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.operators.catalog import map_to_catalog
from stockline.operators.ledger import AMBIGUOUS, STOCK_KEY, unique_stock
from stockline.operators.products import last_write, with_defaults

FIELDS = ["quantity", "price_cents", "description", "user_data_field", "graded"]
MISSING_ID = "Product id missing"


def match_by_stock_id(products: DataFrame, inventory: DataFrame) -> DataFrame:
    """Add item_id and the number of ``matches``; the blueprint plays no part."""
    stock = unique_stock(inventory).select(*STOCK_KEY, "matches", "item_id")
    return products.join(stock, STOCK_KEY, "left")


def reconcile_outcomes(export: DataFrame, resolved: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each product with its ``outcome`` (updated, created or error) and error text."""
    filled = with_defaults(export, reconcile=True).withColumn("external_stock_id", F.col("id").cast("string"))
    known = last_write(filled.where(F.col("id").isNotNull()), STOCK_KEY)
    mapped = map_to_catalog(known, resolved)
    shown = F.coalesce(F.col("blueprint_id").cast("string"), F.lit("None"))
    error = (F.when(F.col("matches") > 1, AMBIGUOUS)
             .when(F.col("matches").isNull() & F.col("print_id").isNull(),
                   F.concat(F.lit("Blueprint "), shown, F.lit(" not found in mapping"))))
    matched = match_by_stock_id(mapped, inventory).withColumn("error", error).withColumn(
        "outcome", F.when(F.col("error").isNotNull(), "error")
        .when(F.col("matches").isNotNull(), "updated").otherwise("created"))
    columns = [*filled.columns, "print_id", "item_id", "outcome", "error"]
    nameless = (filled.where(F.col("id").isNull())
                .withColumns({"outcome": F.lit("error"), "error": F.lit(MISSING_ID)}))
    return matched.select(columns).unionByName(nameless, allowMissingColumns=True)


def reconcile(outcomes: DataFrame, inventory: DataFrame, now: Column) -> DataFrame:
    """The inventory after reconciliation: matched items have six fields overwritten, mapped new
    products are added under their source blueprint id. Nothing is removed."""
    updates = outcomes.where(F.col("outcome") == "updated").select(
        F.col("item_id").alias("id"), *[F.col(f).alias(f"_{f}") for f in FIELDS],
        F.col("properties_hash").alias("_properties"), F.lit(True).alias("_touched"))
    touched = F.col("_touched").isNotNull()
    fields = [*FIELDS, "properties"]
    current = (inventory.join(updates, "id", "left")
               .withColumns({f: F.when(touched, F.col(f"_{f}")).otherwise(F.col(f)) for f in fields})
               .withColumn("updated_at", F.when(touched, now).otherwise(F.col("updated_at")))
               .select(*inventory.columns))
    created = outcomes.where(F.col("outcome") == "created").select(
        F.lit(None).cast("long").alias("id"), "user_id", "blueprint_id", "external_stock_id", *FIELDS,
        F.col("properties_hash").alias("properties"), now.alias("created_at"), now.alias("updated_at"))
    return current.unionByName(created.select(*inventory.columns))


def reconcile_summary(outcomes: DataFrame) -> DataFrame:
    """Counts per seller. The errors stay rows of their own (``reconcile_errors``): a seller may have
    any number of them."""
    outcome = F.col("outcome")
    return outcomes.groupBy("user_id").agg(
        F.count_if(outcome == "updated").alias("updated"), F.count_if(outcome == "created").alias("created"),
        F.count_if(outcome == "error").alias("errors"),
        F.count_if(outcome != "error").alias("total_processed"))


def reconcile_errors(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome") == "error").select(
        "user_id", F.col("external_stock_id").alias("product_id"), "error")
