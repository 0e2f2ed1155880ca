"""Purchase decisions against local and remote stock.

An item's requests are decided in order of arrival. A request that fits both stocks lowers both; one
that does not sets the local stock to the remote one. So until the first failure a request succeeds
exactly if the running sum of requests stays within the smaller stock, and from then on there is one
stock, from which each request is served if it fits and otherwise skipped.

Serving "if it fits" depends on all earlier answers, but only few requests are ever in doubt:

* round 1 and 2 settle, by running sums, everything up to the first request that does not fit; what
  is larger than the stock can be dropped at once, because the stock only falls;
* after round 2 less stock is left than the size of one request that was refused. Of requests of
  size n only the first (stock / n) can still be served, so what an item brings into the final fold
  is bounded by the size of a single request, not by the number of requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.operators.scan import SLICE, Running, numbered, place, running, time_slice
from stockline.session import cut

# Reasons for which a request is refused.
NOT_FOUND = "Inventory item not found"
NO_SETTINGS = "User not found in sync settings"
NO_TOKEN = "no token"
_ITEM = ["item_id"]
_ORDER = ["ts", "request_id"]


def remote_stock(export: DataFrame, order: str = "seq") -> DataFrame:
    """Remote quantity per (seller, stock id). Of a repeated product the last row counts, as in an
    import; without an ``order`` column it is the one with the largest quantity. No quantity is 0."""
    quantity = F.coalesce("quantity", F.lit(0))
    last = F.max_by(quantity, F.struct(order, quantity)) if order in export.columns else F.max(quantity)
    return (export.where(F.col("id").isNotNull())
            .groupBy("user_id", F.col("id").cast("string").alias("external_stock_id"))
            .agg(last.cast("long").alias("remote_quantity")))


def check_availability(ids: DataFrame, export: DataFrame) -> DataFrame:
    """Remote availability of each wanted (user_id, external_stock_id)."""
    number = F.expr("try_cast(external_stock_id as bigint)")
    remote = remote_stock(export).withColumnRenamed("external_stock_id", "_stock_id")
    found = F.col("remote_quantity").isNotNull()
    return (ids.withColumn("_stock_id", number.cast("string"))
            .join(remote, ["user_id", "_stock_id"], "left")
            .select(*ids.columns, F.coalesce(F.col("remote_quantity") > 0, F.lit(False)).alias("available"),
                    F.coalesce("remote_quantity", F.lit(0)).alias("quantity"),
                    F.when(~found, F.concat(F.lit("Product "), F.coalesce("external_stock_id", F.lit("None")),
                                            F.lit(" not found in inventory"))).alias("error")))


def _round(rows: DataFrame, stock: Column, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``served`` and ``reached``, units sold per item).

    ``rows`` has item_id, quantity, the order columns and its slices. Everything that is ``reached``, that is up
    to the first request that does not fit, is decided.
    """
    summed = running(rows.withColumn("_stock", stock), _ITEM, _ORDER, None,
                     {"_run": Running("sum", F.col("quantity").cast("long"))})
    served = F.col("_run") <= F.col("_stock")
    reached = F.col("_run") - F.col("quantity") <= F.col("_stock")
    decided = cut(summed.withColumns({"served": served, "reached": reached}), label)
    sold = decided.groupBy(*_ITEM).agg(F.sum(F.when(F.col("served"), F.col("quantity")).otherwise(0)).alias("_sold"))
    return decided, sold


def decide_purchases(requests: DataFrame, inventory: DataFrame, export: DataFrame,
                     settings: DataFrame | None = None) -> DataFrame:
    """One row per request: outcome, quantities before and after, and the remote action it causes.

    ``requests`` has request_id (unique), item_id, user_id, quantity (at least 1) and ts. With
    ``settings`` (user_id, has_token), requests to sellers without settings or token are refused and
    leave the stock alone; one that the local stock can't meet says so first. The requests with their
    items and each round's answers are written once, as later steps read them several times.
    """
    items = (inventory.select(F.col("id").alias("item_id"), "user_id", "external_stock_id",
                              F.col("quantity").cast("long").alias("local"))
             .join(remote_stock(export), ["user_id", "external_stock_id"], "left")
             .select("item_id", "user_id", "external_stock_id", "local",
                     F.coalesce("remote_quantity", F.lit(0)).cast("long").alias("remote"),
                     F.coalesce(F.col("external_stock_id") != "", F.lit(False)).alias("linked")))
    wanted = requests.join(items, ["item_id", "user_id"], "left").withColumn("refusal", F.lit(None).cast("string"))
    if settings is not None:
        token = settings.select("user_id", F.coalesce("has_token", F.lit(False)).alias("_token"))
        wanted = wanted.join(token, "user_id", "left").withColumn(
            "refusal", F.when(F.col("_token").isNull(), NO_SETTINGS).when(~F.col("_token"), NO_TOKEN))
    wanted = wanted.withColumn("linked", F.col("linked") & F.col("refusal").isNull())
    base = cut(wanted.select(*requests.columns, "external_stock_id", "local", "remote", "linked", "refusal"), "purchases")
    # Slices are found once: what is left of an item's requests in a later round is in the same ones.
    live = place(base.where(F.col("linked")), _ITEM, _ORDER, time_slice(F.col("ts")))
    rest = base.where(~F.coalesce("linked", F.lit(False)))

    first, sold_first = _round(live, F.least("local", "remote"), "first-round")
    open_second = (first.where(~F.col("reached")).join(sold_first, _ITEM)
                   .withColumn("_left", F.col("remote") - F.col("_sold"))
                   .where(F.col("quantity") <= F.col("_left"))
                   .select(*_ITEM, *_ORDER, "quantity", "_left", SLICE))
    second, sold_second = _round(cut(open_second, "open"), F.col("_left"), "second-round")
    open_third = (second.where(~F.col("reached")).join(sold_second, _ITEM)
                  .withColumn("_left", F.col("_stock") - F.col("_sold"))
                  .where(F.col("quantity") <= F.col("_left"))
                  .select(*_ITEM, *_ORDER, "quantity", "_left", SLICE))
    winners = (second.where(F.col("served")).select(*_ITEM, "request_id")
               .unionByName(_serve_rest(open_third)).withColumn("_won", F.lit(True)))

    answered = (first.join(winners, [*_ITEM, "request_id"], "left")
                .withColumn("served", F.col("served") | F.col("_won").isNotNull())
                .select(*base.columns, "served", "reached", SLICE))
    sold = running(cut(answered, "answers"), _ITEM, _ORDER, None, {
        "_sold": Running("sum", F.when(F.col("served"), F.col("quantity")).otherwise(0).cast("long"), False)})
    before = F.when(F.col("reached"), F.col("local")).otherwise(F.col("remote")) - F.col("_sold")
    remote_now = F.col("remote") - F.col("_sold")
    served = F.col("served")
    remaining = remote_now - F.col("quantity")
    outcome = sold.withColumn("quantity_before", before).select(
        *requests.columns, "external_stock_id",
        F.when(served, "success").otherwise("error").alias("status"),
        "quantity_before",
        F.when(served, F.col("quantity_before") - F.col("quantity")).otherwise(remote_now).alias("quantity_after"),
        F.when(served, F.col("quantity")).otherwise(0).cast("long").alias("quantity_purchased"),
        F.when(~served, F.concat(
            F.when(F.col("quantity_before") < F.col("quantity"), F.lit("Insufficient quantity"))
            .otherwise(F.lit("Insufficient quantity on marketplace")),
            F.lit(". Available: "), remote_now.cast("string"),
            F.lit(", Requested: "), F.col("quantity").cast("string"))).alias("error"),
        F.when(served, F.when(remaining > 0, "increment").otherwise("delete")).alias("remote_action"),
        F.when(served & (remaining > 0), -F.col("quantity")).cast("long").alias("remote_delta"))
    return outcome.unionByName(_unlinked(rest, requests).select(outcome.columns))


def _serve_rest(candidates: DataFrame) -> DataFrame:
    """Item and request id of what is served from the last bit of stock."""
    possible = numbered(cut(candidates, "last-stock"), ["item_id", "quantity"], _ORDER).where(
        F.col("position") * F.col("quantity") <= F.col("_left"))
    queue = F.array_sort(F.collect_list(F.struct("ts", "request_id", F.col("quantity").cast("long").alias("n"))))
    id_type = candidates.schema["request_id"].dataType.simpleString()
    served = F.aggregate(
        "queue",
        F.struct(F.col("_left").cast("long").alias("stock"), F.array().cast(f"array<{id_type}>").alias("won")),
        lambda state, r: F.when(r["n"] <= state["stock"], F.struct(
            (state["stock"] - r["n"]).alias("stock"),
            F.concat(state["won"], F.array(r["request_id"])).alias("won"))).otherwise(state),
        lambda state: state["won"])
    return (possible.groupBy(*_ITEM).agg(queue.alias("queue"), F.max("_left").alias("_left"))
            .select(*_ITEM, F.explode(served).alias("request_id")))


def _unlinked(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests for unknown items, for items without a remote product, or to sellers without settings
    or token: nothing is ever sold."""
    missing = F.col("local").isNull()
    short = F.col("local") < F.col("quantity")
    product = F.when(F.col("external_stock_id") != "", F.col("external_stock_id"))
    error = (F.when(missing, NOT_FOUND)
             .when(short, F.concat(F.lit("Insufficient quantity. Available: "), F.col("local").cast("string"),
                                   F.lit(", Requested: "), F.col("quantity").cast("string")))
             .when(product.isNull(), "Missing external_stock_id").otherwise(F.col("refusal")))
    refused = ~short & product.isNotNull()
    return rows.select(
        *requests.columns, product.alias("external_stock_id"),
        F.when(missing, "not_found").when(refused, "refused").otherwise("error").alias("status"),
        F.col("local").alias("quantity_before"), F.col("local").alias("quantity_after"),
        F.lit(0).cast("long").alias("quantity_purchased"), error.alias("error"),
        F.lit(None).cast("string").alias("remote_action"), F.lit(None).cast("long").alias("remote_delta"))


def settle_purchases(inventory: DataFrame, decisions: DataFrame, now: Column | None = None) -> DataFrame:
    """The inventory after the decided purchases: each item's quantity after its last request.

    ``now`` becomes the ``updated_at`` of the items whose quantity differs.
    """
    last = (decisions.where(F.col("quantity_after").isNotNull()).groupBy(F.col("item_id").alias("id"))
            .agg(F.max_by("quantity_after", F.struct("ts", "request_id")).alias("_after")))
    kind = inventory.schema["quantity"].dataType
    after = F.coalesce(F.col("_after").cast(kind), F.col("quantity"))
    changes = {"quantity": after}
    if now is not None:
        changes["updated_at"] = F.when(after.eqNullSafe(F.col("quantity")), F.col("updated_at")).otherwise(now)
    return inventory.join(last, "id", "left").withColumns(changes).select(*inventory.columns)
