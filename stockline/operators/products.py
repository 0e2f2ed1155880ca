"""Rules for rows of a product export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockline.operators.scan import keep_one, number_slice, numbered

CHUNK_SIZE = 5000
EXCLUDED_SOURCES = ("op_prints",)


def _present(name: str) -> Column:
    """Neither null nor zero."""
    return F.coalesce(F.col(name) != 0, F.lit(False))


def is_valid() -> Column:
    return _present("blueprint_id") & _present("id")


def valid_products(export: DataFrame) -> DataFrame:
    return export.where(is_valid())


def invalid_products(export: DataFrame) -> DataFrame:
    return export.where(~is_valid())


def exclude_sources(mapped: DataFrame, excluded: Sequence[str] = EXCLUDED_SOURCES) -> DataFrame:
    """Keep products that are mapped, and not to an excluded source."""
    return mapped.where(F.col("table_name").isNotNull() & ~F.col("table_name").isin(list(excluded)))


def skip_reason(excluded: Sequence[str] = EXCLUDED_SOURCES) -> Column:
    """Why a product (already left-joined to the catalog) is skipped; null if it is not."""
    return (F.when(~is_valid(), "missing id")
            .when(F.col("table_name").isNull(), "no catalog mapping")
            .when(F.col("table_name").isin(list(excluded)), "excluded source"))


def skipped_products(export: DataFrame, resolved: DataFrame,
                     excluded: Sequence[str] = EXCLUDED_SOURCES) -> DataFrame:
    """Every skipped row with its reason. Invalid rows never take part in the join, so that their
    null keys do not meet in one partition."""
    joined = valid_products(export).join(resolved, "blueprint_id", "left")
    known = joined.withColumn("reason", skip_reason(excluded)).where(F.col("reason").isNotNull())
    missing = invalid_products(export).withColumn("reason", F.lit("missing id"))
    return known.select(*export.columns, "reason").unionByName(missing)


def with_defaults(export: DataFrame, reconcile: bool = False) -> DataFrame:
    """Absent quantity and price become 0, absent properties an empty object; the reconcile path
    also fills texts and the graded flag."""
    defaults = {"quantity": F.lit(0), "price_cents": F.lit(0), "properties_hash": F.lit("{}")}
    if reconcile:
        defaults |= {"description": F.lit(""), "user_data_field": F.lit(""), "graded": F.lit(False)}
    return export.withColumns({
        name: F.coalesce(F.col(name), value) for name, value in defaults.items() if name in export.columns})


def last_write(export: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The last row per key."""
    return keep_one(export, keys, F.col(order).desc())


def _slice(export: DataFrame, order: str) -> Column:
    """Places in files are cut by block, numbers by range."""
    if isinstance(export.schema[order].dataType, StructType):
        return F.struct(f"{order}.file", f"{order}.block")
    return number_slice(F.col(order))


def chunk_index(export: DataFrame, size: int = CHUNK_SIZE, order: str = "seq") -> DataFrame:
    """Position of each row in its seller's export, its chunk and the seller's number of chunks."""
    placed = numbered(export, ["user_id"], [order], _slice(export, order))
    totals = export.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("total_chunks"))
    totals = totals.withColumnRenamed("user_id", "_seller")
    # Rows without a seller are chunked together.
    return (placed.join(totals, F.col("user_id").eqNullSafe(F.col("_seller"))).drop("_seller")
            .withColumn("chunk", F.floor((F.col("position") - 1) / F.lit(size))))


def user_expansions(export: DataFrame) -> DataFrame:
    return export.where(F.col("expansion_id").isNotNull()).select("user_id", "expansion_id").distinct()
