"""The product catalog: one tagged table out of four, and one mapping per blueprint."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockline.schemas import CATALOG_TABLES


def catalog_union(tables: Mapping[str, DataFrame], needed: DataFrame | None = None,
                  distinct: bool = True) -> DataFrame:
    """UNION of the catalog tables, tagged with table name and priority.

    ``needed`` (a ``blueprint_id`` column) keeps only the wanted ids; the semi join is pushed into
    every branch. ``resolve_catalog`` does not mind duplicates, so ``distinct=False`` saves it a
    shuffle per table.
    """
    result = None
    for priority, name in enumerate(CATALOG_TABLES, start=1):
        if name not in tables:
            continue
        tagged = tables[name].select(
            F.col("id").alias("print_id"), F.lit(name).alias("table_name"),
            F.col("blueprint_id"), F.lit(priority).alias("priority"))
        if needed is not None:
            tagged = tagged.join(needed.select("blueprint_id").distinct(), "blueprint_id", "left_semi")
        if distinct:
            # Tables carry different tags, so duplicates exist only inside one table.
            tagged = tagged.distinct()
        result = tagged if result is None else result.unionByName(tagged)
    return result


def resolve_catalog(catalog: DataFrame, on_conflict: str = "first") -> DataFrame:
    """One (print_id, table_name) per blueprint: the first source in priority order, or the last."""
    if on_conflict not in ("first", "last"):
        raise ValueError("on_conflict must be 'first' or 'last'")
    rank = F.col("priority") if on_conflict == "first" else -F.col("priority")
    best = F.min(F.struct(rank.alias("rank"), "print_id", "table_name"))
    return (catalog.where(F.col("blueprint_id").isNotNull())
            .groupBy("blueprint_id").agg(best.alias("best"))
            .select("blueprint_id", "best.print_id", "best.table_name"))


def map_to_catalog(products: DataFrame, resolved: DataFrame) -> DataFrame:
    """Left join products to the resolved catalog; unmapped products get nulls.

    No broadcast hint: Spark broadcasts the catalog when its size is under
    ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, where AQE splits the
    partition of a card that many sellers hold.
    """
    return products.join(resolved, "blueprint_id", "left")
