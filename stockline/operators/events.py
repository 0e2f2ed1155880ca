"""Order events: who they concern, what they do to stock, and what came of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.functions.quality import canonical_uuid
from stockline.operators.ledger import AMBIGUOUS, NOT_FOUND, unique_stock
from stockline.operators.scan import keep_one

LINE_ORDER = ["ts", "event_id", "ln", "quantity"]


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _shown(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def route(cause: Column, state: Column, previous_state: Column) -> Column:
    """sell, restore or ignored."""
    state = _text(state)
    return (F.when(cause == "order.create", F.when(state == "paid", "sell").otherwise("ignored"))
            .when(cause == "order.update",
                  F.when(state.isin("canceled", "request_for_cancel")
                         | ((_text(previous_state) == "paid") & (state != "paid")), "restore")
                  .otherwise("ignored"))
            .when(cause == "order.destroy", "restore")
            .otherwise("ignored"))


def ignore_reason(cause: Column, state: Column, previous_state: Column) -> Column:
    """Why an event is ignored (null if it is not)."""
    # The texts of the reasons.
    shown = _text(state)
    reason = (F.when(cause == "order.create", F.concat(F.lit("Order state is '"), shown, F.lit("', not 'paid'")))
              .when(cause == "order.update",
                    F.concat(F.lit("Order state change from '"), _shown(previous_state), F.lit("' to '"), shown,
                             F.lit("' doesn't require quantity adjustment")))
              .otherwise(F.lit("Unsupported webhook cause")))
    return F.when(route(cause, state, previous_state) == "ignored", reason)


def route_events(events: DataFrame) -> DataFrame:
    """Add ``action`` and ``reason`` to nested order events."""
    args = F.col("cause"), F.col("data.state"), F.col("data.previous_state")
    return events.withColumns({"action": route(*args), "reason": ignore_reason(*args)})


def resolve_seller(events: DataFrame) -> DataFrame:
    """Seller given with the event, else the one inside it; ``seller_error`` if there is none or it
    is no UUID. Only events that act on stock can fail."""
    given = F.coalesce(F.when(F.col("user_id") != "", F.col("user_id")),
                       F.when(~F.col("data.seller.id").isin("", "0"), F.col("data.seller.id")))
    seller = canonical_uuid(given)
    error = (F.when(given.isNull(), "No user_id provided and cannot extract from order")
             .when(seller.isNull(), F.concat(F.lit("Invalid user_id format: "), given)))
    return events.withColumns({"seller_id": seller, "seller_error": error})


def identity(events: DataFrame) -> Column:
    """What tells an event from others: the key its reader gave it, else its id."""
    return F.col("event_key") if "event_key" in events.columns else F.col("id")


def explode_lines(events: DataFrame) -> DataFrame:
    """One row per order line of the events that act on stock, in their order of application. ``event_id`` is the
    event's identity, so that lines of events without an id stay apart."""
    return (events.where(F.col("action") != "ignored")
            .select("*", F.posexplode("data.order_items").alias("ln", "_item"))
            .select(identity(events).alias("event_id"), F.col("data.id").alias("order_id"), "ts", "user_id", "action",
                    "ln", F.col("_item.product_id").alias("product_id"), F.col("_item.quantity").alias("quantity")))


def valid_order_lines(lines: DataFrame) -> DataFrame:
    """Drop lines without a product or with no positive quantity."""
    product = F.col("product_id")
    return lines.where(product.isNotNull() & ~product.cast("string").isin("", "0")
                       & (F.coalesce(F.col("quantity"), F.lit(0)) > 0))


def line_deltas(lines: DataFrame) -> DataFrame:
    """Order lines as stock changes: a sale subtracts, a restore adds."""
    signed = F.when(F.col("action") == "sell", -F.col("quantity")).otherwise(F.col("quantity"))
    return (lines.withColumn("external_stock_id", F.col("product_id").cast("string"))
            .withColumn("delta", signed.cast("long")))


def match_order_lines(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Find each line's item by seller and stock id; no match or several are errors.

    The inventory side has one row per key, so a product that a third of all lines name only makes
    the line side skewed, which AQE splits.
    """
    stock = unique_stock(inventory).select(
        F.col("user_id"), F.col("external_stock_id").alias("product_id"), "matches", "item_id")
    return lines.join(stock, ["user_id", "product_id"], "left").select(
        *lines.columns, F.when(F.col("matches") == 1, F.col("item_id")).alias("item_id"),
        F.when(F.col("matches").isNull(), NOT_FOUND).when(F.col("matches") > 1, AMBIGUOUS).alias("error"))


def event_results(applied: DataFrame) -> DataFrame:
    """One row per event from its applied lines.

    The lists of an event hold what one input record held, so a group is as large as one record.
    """
    line = F.struct("ln", F.col("external_stock_id").alias("product_id"), "old_quantity", "new_quantity",
                    F.abs("delta").alias("moved_quantity"), "error")
    lines = F.col("_lines")
    items = F.transform(F.filter(lines, lambda i: i["error"].isNull()), lambda i: i.dropFields("error"))
    errors = F.transform(F.filter(lines, lambda i: i["error"].isNotNull()),
                         lambda i: F.struct(i["ln"].alias("ln"), i["product_id"].alias("product_id"),
                                            i["error"].alias("error")))
    # Dealt by what answers are looked up by, so that events join them where they lie.
    return (applied.repartition("event_id", "user_id").groupBy("event_id", "user_id", "action").agg(F.array_sort(F.collect_list(line)).alias("_lines"))
            .select("event_id", "user_id", "action",
                    F.size(F.filter(lines, lambda i: i["error"].isNull())).cast("long").alias("items_processed"),
                    items.alias("items"), errors.alias("errors"), F.lit("processed").alias("status")))


def with_recipient(events: DataFrame) -> DataFrame:
    """Events with the seller they were sent to, or that they name, as ``_recipient``: one id sent to two sellers is
    two events."""
    sent = [F.when(F.col("user_id") != "", F.col("user_id").cast("string"))] if "user_id" in events.columns else []
    named = [F.col("data.seller.id")] if "data" in events.columns else []
    return events.withColumn("_recipient", F.coalesce(*sent, *named, F.lit("")))


def told_apart(events: DataFrame, key: str) -> DataFrame:
    """Events with what tells them apart beside their id: the recipient, and for those without an id a name drawn for each.
    So all go one way, and a feed is read and parsed once."""
    return with_recipient(events).withColumn(
        "_recipient", F.when(is_named(F.col(key)), F.col("_recipient")).otherwise(F.uuid()))


def dedupe_events(events: DataFrame, key: str = "id", arrival: str = "ts") -> DataFrame:
    """Keep the first arrival of each event (batch form of ``dedupe_stream``).

    Events without an id are not known to be the same one, so all of them stay.
    """
    return keep_one(told_apart(events, key), [key, "_recipient"], F.col(arrival).asc_nulls_last()).drop("_recipient")


def is_named(event_id: Column) -> Column:
    """Whether an event has an id of its own; readers put ``unknown`` where the feed has none."""
    return event_id.isNotNull() & (event_id.cast("string") != "unknown")
