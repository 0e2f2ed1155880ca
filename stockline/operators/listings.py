"""Reads of the inventory: listings per card, pages per seller, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import properties as props


def _rows(limit: int, offset: int = 0) -> int:
    if limit < 1 or offset < 0:
        raise ValueError("a limit is at least 1, an offset at least 0")
    return limit


def in_stock(inventory: DataFrame) -> DataFrame:
    return inventory.where(F.col("quantity") > 0)


def seller_name(user_id: Column) -> Column:
    return F.concat(F.lit("Venditore #"), F.substring(user_id.cast("string"), 1, 8))


def listing_columns(items: DataFrame) -> DataFrame:
    """Items as public listings; condition and language only where they are text."""
    values = F.col("_values")
    return items.withColumn("_values", props.parse(F.col("properties"))).select(
        F.col("id").alias("item_id"), F.col("user_id").alias("seller_id"),
        seller_name(F.col("user_id")).alias("seller_display_name"), F.lit(None).cast("string").alias("country"),
        "blueprint_id", "quantity", "price_cents",
        props.as_text(F.element_at(values, "condition")).alias("condition"),
        props.as_text(F.element_at(values, "mtg_language")).alias("mtg_language"))


def top_listings(inventory: DataFrame, limit: int = 100) -> DataFrame:
    """The cheapest items in stock per card. Spark keeps at most ``limit`` rows per card and task
    before the shuffle."""
    cheapest = Window.partitionBy("blueprint_id").orderBy("price_cents", "id")
    return (in_stock(inventory).withColumn("rank", F.row_number().over(cheapest))
            .where(F.col("rank") <= _rows(limit)))


def listings_for(inventory: DataFrame, blueprint_id: int, limit: int = 100) -> DataFrame:
    return (in_stock(inventory).where(F.col("blueprint_id") == blueprint_id)
            .orderBy("price_cents", "id").limit(_rows(limit)))


def inventory_page(inventory: DataFrame, user_id, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a seller's items, newest first."""
    return (inventory.where(F.col("user_id") == F.lit(user_id))
            .orderBy(F.col("updated_at").desc(), "id")
            .offset(offset).limit(_rows(limit, offset)))


def inventory_total(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))


def inventory_stats(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.sum("quantity").alias("total_quantity"),
        F.avg("price_cents").alias("avg_price"))
