"""Edits of inventory items and the outbound records they cause."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.functions import properties as props
from stockline.functions.quality import strip
from stockline.session import cut

PATCH_FIELDS = ["quantity", "price_cents", "description", "user_data_field", "graded", "properties"]
MAX_DESCRIPTION = 5000
MAX_USER_DATA = 1000
# Fixed value: text of an unknown item.
DELETE_NOT_FOUND = "Inventory item not found"


def validate_patch(patches: DataFrame) -> DataFrame:
    """Blank texts become null; ``errors`` lists what is wrong with a patch."""
    def blank_to_null(name: str) -> Column:
        return F.when(strip(F.col(name)) != "", F.col(name))

    errors = F.array_compact(F.array(
        F.when(F.col("quantity") < 0, "Quantity must be >= 0"),
        F.when(F.col("price_cents") < 0, "Price must be >= 0"),
        F.when(F.length("description") > MAX_DESCRIPTION, f"description is longer than {MAX_DESCRIPTION}"),
        F.when(F.length("user_data_field") > MAX_USER_DATA, f"user_data_field is longer than {MAX_USER_DATA}"),
        F.when(F.coalesce(*[F.col(f).cast("string") for f in
                            ("quantity", "price_cents", "graded", "properties")],
                          blank_to_null("description"), blank_to_null("user_data_field")).isNull(),
               "At least one field must be provided for update")))
    return patches.withColumn("errors", errors).withColumns({
        "description": blank_to_null("description"), "user_data_field": blank_to_null("user_data_field")})


def collapse_patches(patches: DataFrame, order: str) -> DataFrame:
    """Several patches of an item as one: per field, and per property key, the last value that is
    not null wins."""
    key = ["user_id", "item_id"]
    plain = [f for f in PATCH_FIELDS if f != "properties"]
    fields = patches.groupBy(*key).agg(
        *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in plain],
        F.max(F.col("properties").isNotNull()).alias("_has_properties"))
    latest = (patches.where(F.col("properties").isNotNull())
              .select(*key, order, F.explode(props.parse(F.col("properties"))).alias("name", "value"))
              .where(~F.is_variant_null("value")).withColumn("value", F.to_json("value"))
              .groupBy(*key, "name").agg(F.max_by("value", order).alias("value"))
              .groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("_entries")))
    members = F.transform("_entries", lambda e: F.concat(
        F.regexp_replace(F.to_json(F.array(e["name"])), r"^\[|\]$", ""), F.lit(":"), e["value"]))
    text = F.concat(F.lit("{"), F.coalesce(F.array_join(members, ","), F.lit("")), F.lit("}"))
    return fields.join(latest, key, "left").select(
        *key, *plain, F.when(F.col("_has_properties"), text).alias("properties"))


def _single(patches: DataFrame) -> DataFrame:
    """One patch per item. Two patches of an item stop the job, as nothing tells which is the later
    one: ``collapse_patches`` makes one of them first."""
    key = ["item_id", "user_id"]
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(
        F.lit("several patches of item "), F.max(F.col("item_id").cast("string")))).cast("boolean"))
    return (patches.groupBy(*key).agg(*[F.first(f).alias(f) for f in PATCH_FIELDS], single.alias("_several"))
            .where(F.col("_several").isNull()))


def _with_patch(inventory: DataFrame, patches: DataFrame, how: str) -> DataFrame:
    """Items with their patch."""
    renamed = _single(patches).select(F.col("item_id").alias("id"), "user_id",
                                      *[F.col(f).alias(f"patch_{f}") for f in PATCH_FIELDS], F.lit(True).alias("_patched"))
    return inventory.join(renamed, ["id", "user_id"], how)


def place_patches(inventory: DataFrame, patches: DataFrame, place: Callable[[DataFrame], DataFrame],
                  within: list[str]) -> DataFrame:
    """All items, each with its patch, where ``place`` puts them: items and patches go there together, so that rows which
    are wanted in that order anyway are not moved once more for the join.

    ``place`` adds the columns ``within``, which follow from id and user_id wherever both are given, and brings rows that
    agree in them to one task.
    """
    kind = dict(inventory.dtypes)
    fields = F.struct(*PATCH_FIELDS).alias("_patch")
    # Nothing is a patch of an item that has no id or no seller.
    named = _single(patches.where(F.col("item_id").isNotNull() & F.col("user_id").isNotNull())).select(
        F.col("item_id").cast(kind["id"]).alias("id"), F.col("user_id").cast(kind["user_id"]).alias("user_id"), fields)
    together = place(inventory.withColumn("_item", F.lit(True)).unionByName(named, allowMissingColumns=True))
    patch = F.first("_patch", ignorenulls=True).over(Window.partitionBy(*within, "id", "user_id"))
    return (together.withColumn("_patch", patch).where("_item")
            .select(*inventory.columns, *within, *[F.col("_patch")[f].alias(f"patch_{f}") for f in PATCH_FIELDS],
                    F.when(F.col("_patch").isNotNull(), F.lit(True)).alias("_patched")))


def patched(joined: DataFrame, now: Column) -> DataFrame:
    """Items that stand beside their patch, after it."""
    changed = {f: F.coalesce(F.col(f"patch_{f}"), F.col(f)) for f in PATCH_FIELDS if f != "properties"}
    changed["properties"] = F.when(
        F.col("patch_properties").isNotNull(),
        props.merge_properties(F.col("properties"), F.col("patch_properties"))).otherwise(F.col("properties"))
    changed["updated_at"] = F.when(F.col("_patched").isNotNull(), now).otherwise(F.col("updated_at"))
    return joined.withColumns(changed).drop("_patched", *[f"patch_{f}" for f in PATCH_FIELDS])


def apply_patches(inventory: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """The inventory after one patch per item: given fields replace, properties merge key by key,
    and ``updated_at`` always moves."""
    return patched(_with_patch(inventory, patches, "left"), now).select(*inventory.columns)


def change_flags() -> dict[str, Column]:
    """What the patch that stands beside an item changes, and whether the item must be sent out."""
    def differs(field: str) -> Column:
        return F.col(f"patch_{field}").isNotNull() & ~F.col(f"patch_{field}").eqNullSafe(F.col(field))

    flags = {f"{f}_changed": differs(f) for f in PATCH_FIELDS if f not in ("properties", "price_cents")}
    flags["price_changed"] = differs("price_cents")
    old = F.coalesce(props.canonical_json(F.col("properties")), F.lit("{}"))
    has_properties = F.col("patch_properties").isNotNull()
    flags["properties_changed"] = has_properties & (old != props.canonical_json(F.col("patch_properties")))
    merged = props.canonical_json(props.merge_properties(F.col("properties"), F.col("patch_properties")))
    any_changed = plain_changed = F.lit(False)
    for name, flag in flags.items():
        any_changed = any_changed | flag
        if name != "properties_changed":
            plain_changed = plain_changed | flag
    linked = F.coalesce(strip(F.col("external_stock_id")) != "", F.lit(False))
    return {**flags, "effective_change": plain_changed | F.coalesce(has_properties & (old != merged), F.lit(False)),
            "sync_needed": linked & any_changed}


def detect_changes(inventory: DataFrame, patches: DataFrame) -> DataFrame:
    """What each patch changes, and whether it must be sent out.

    A partial property patch differs from the stored properties and so always counts as a change;
    ``effective_change`` tells whether the merged item really differs.
    """
    flags = change_flags()
    return _with_patch(inventory, patches, "inner").withColumns(flags).select(
        "id", "user_id", "external_stock_id", *flags)


def due_items(edited: DataFrame) -> DataFrame:
    """Of items with ``sync_needed``, those to be sent out: they need it, or another row with their id does.

    Only ids are moved to find ids that stand on rows of both kinds.
    """
    needed = F.coalesce(F.col("sync_needed"), F.lit(False))
    both = cut(edited.groupBy("id").agg(F.max(needed).alias("_some"), F.min(needed).alias("_all"))
               .where(F.col("_some") & ~F.col("_all")).select("id"), "repeated")
    if both.isEmpty():
        return edited.where(needed)
    return edited.where(needed).unionByName(edited.where(~needed).join(both, "id", "left_semi"))


def broken_properties(inventory: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches whose properties can't be merged, as those of the item are no JSON object. The item's other
    fields are patched, its properties stay."""
    hit = patches.where(F.col("properties").isNotNull()).select("user_id", F.col("item_id").alias("id"))
    items = inventory.where(props.is_broken(F.col("properties"))).select("user_id", "id")
    return items.join(hit, ["user_id", "id"], "left_semi").select(
        "user_id", F.col("id").alias("item_id"), F.lit("Stored properties are no JSON object").alias("error"))


def build_update_payload(items: DataFrame) -> DataFrame:
    """Outbound update record of each item, as JSON in ``body``; ``status`` is queued, skipped or, where
    the stock id is no number, error.

    Null fields are left out of the record. Price goes out in currency units.
    """
    sent = props.outbound_map(props.parse(F.col("properties")))
    prepared = items.withColumn("_sent", sent)
    stock_id = F.col("external_stock_id").try_cast("long")
    body = F.struct(
        stock_id.alias("id"),
        (F.col("price_cents") / F.lit(100.0)).alias("price"), "quantity", "description", "user_data_field", "graded",
        F.when(F.size("_sent") > 0, F.col("_sent")).alias("properties"))
    linked = F.coalesce(F.col("external_stock_id") != "", F.lit(False))
    return prepared.select(
        "user_id", F.col("id").alias("item_id"), "external_stock_id",
        F.when(linked & stock_id.isNotNull(), "queued").when(linked, "error").otherwise("skipped").alias("status"),
        F.when(~linked, "no_external_stock_id").when(stock_id.isNull(), "invalid_external_stock_id").alias("reason"),
        F.when(linked & stock_id.isNotNull(), F.to_json(body)).alias("body"))


def delete_items(inventory: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining inventory, deleted items, requests that name no item).

    ``requests`` has user_id and item_id.
    """
    wanted = requests.select("user_id", F.col("item_id").alias("id")).distinct()
    key = ["user_id", "id"]
    missing = (wanted.join(inventory.select(*key), key, "left_anti")
               .withColumn("error", F.lit(DELETE_NOT_FOUND)))
    return inventory.join(wanted, key, "left_anti"), inventory.join(wanted, key, "left_semi"), missing


def delete_results(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Outcome of outbound deletes. A missing remote product counts as deleted already.

    ``requests`` and ``responses`` share request_id; a response has status_code and message.
    """
    joined = requests.join(responses, "request_id", "left")
    text = F.coalesce(F.col("message"), F.lit(""))
    failed = F.coalesce(F.col("status_code") >= 400, F.lit(True))
    gone = failed & (F.coalesce(F.col("status_code") == 404, F.lit(False)) | F.contains(text, F.lit("404"))
                     | F.contains(F.lower(text), F.lit("not_found")))
    return joined.select(
        *requests.columns,
        F.when(~failed | gone, "success").otherwise("error").alias("status"),
        F.when(gone, "Product was already deleted").when(~failed, F.coalesce("message", F.lit("Product deleted")))
        .otherwise(F.concat(F.lit("Failed to delete product: "), text)).alias("message"),
        gone.alias("already_deleted"))
