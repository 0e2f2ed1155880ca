"""Registered queries: order events and the stock ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline import fixtures as fx
from stockline.functions import signature as sig
from stockline.operators import events as ev
from stockline.operators import ledger as lg
from stockline.registry.views import uuid_sql, with_views
from stockline.session import cut

QUERIES = {}
DELTA_ORDER = ["ts", "order_id", "ln", "delta"]


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function
    return add


def deltas(spark, sf_dir):
    lines = fx.lines(spark, sf_dir)
    action = ev.route(F.col("cause"), F.col("state"), F.lit(None).cast("string"))
    routed = lines.withColumn("action", action).where(F.col("action") != "ignored")
    # Derived once: the ledger reads its changes several times.
    return cut(ev.line_deltas(ev.valid_order_lines(routed)).select(
        "user_id", "external_stock_id", "delta", "ts", "order_id", "ln"), "deltas")


_ROUTE = """
    , routed AS (SELECT *, CASE
        WHEN cause='order.create' THEN CASE WHEN state='paid' THEN 'sell' ELSE 'ignored' END
        WHEN cause='order.update' THEN CASE WHEN state IN ('canceled','request_for_cancel')
             OR (coalesce(previous_state,'')='paid' AND state<>'paid') THEN 'restore' ELSE 'ignored' END
        WHEN cause='order.destroy' THEN 'restore' ELSE 'ignored' END AS action FROM lines)"""


@query(with_views("lines", _ROUTE + """
    SELECT CAST(order_id AS VARCHAR)||'-'||CAST(user_id AS VARCHAR) AS id, action,
           CASE WHEN action<>'ignored' THEN NULL
                WHEN cause='order.create' THEN 'Order state is '''||state||''', not ''paid'''
                ELSE 'Order state change from '''||coalesce(previous_state,'None')||''' to '''||state
                     ||''' doesn''t require quantity adjustment' END AS reason
    FROM (SELECT DISTINCT order_id, user_id, cause, state, previous_state, action FROM routed)"""))
def route_events(spark, sf_dir):
    return ev.route_events(fx.order_events(spark, sf_dir)).select("id", "action", "reason")


@query(with_views("lines", f"""
    SELECT CAST(order_id AS VARCHAR)||'-'||CAST(user_id AS VARCHAR) AS id,
           CASE WHEN order_id%7=0 THEN NULL WHEN order_id%7=1 THEN NULL ELSE {uuid_sql('user_id')} END AS seller_id,
           CASE WHEN order_id%7=0 THEN 'No user_id provided and cannot extract from order'
                WHEN order_id%7=1 THEN 'Invalid user_id format: '||CAST(user_id AS VARCHAR)||'x' END AS seller_error
    FROM (SELECT DISTINCT order_id, user_id FROM lines)"""))
def resolve_seller(spark, sf_dir):
    events = fx.order_events(spark, sf_dir)
    order = F.col("data.id")
    given = (F.when(order % 7 == 1, F.concat(F.col("user_id").cast("string"), F.lit("x")))
             .when(order % 7 == 2, F.concat(F.lit("{"), F.upper("data.seller.id"), F.lit("}"))))
    events = events.withColumn("user_id", given).withColumn(
        "data", F.when(order % 7 == 0, F.col("data").withField("seller.id", F.lit("0"))).otherwise(F.col("data")))
    return ev.resolve_seller(events).select("id", "seller_id", "seller_error")


@query(with_views("lines", _ROUTE + """
    SELECT CAST(order_id AS VARCHAR)||'-'||CAST(user_id AS VARCHAR) AS event_id, order_id, ts, user_id, action,
           CAST(row_number() OVER (PARTITION BY order_id, user_id ORDER BY ln, product_id, quantity)-1 AS INT) AS ln,
           product_id, quantity
    FROM routed WHERE action<>'ignored' """))
def ordered_lines(spark, sf_dir):
    return ev.explode_lines(ev.route_events(fx.order_events(spark, sf_dir)))


@query(with_views("lines", """
    SELECT user_id, order_id, ln, product_id, quantity-3 AS quantity FROM lines
    WHERE quantity>3 AND product_id<>'0'"""))
def valid_order_lines(spark, sf_dir):
    lines = fx.lines(spark, sf_dir).withColumn("quantity", F.col("quantity") - 3)
    return ev.valid_order_lines(lines).select("user_id", "order_id", "ln", "product_id", "quantity")


@query(with_views("lines inventory", """
    , stock AS (SELECT user_id, CAST(id//2 AS VARCHAR) AS product_id, count(*) AS matches, min(id) AS item_id
                FROM inventory GROUP BY ALL)
    SELECT l.user_id, order_id, ln, l.product_id, quantity, CASE WHEN matches=1 THEN item_id END AS item_id,
           CASE WHEN matches IS NULL THEN 'Product not found in local inventory'
                WHEN matches>1 THEN 'ambiguous_match' END AS error
    FROM (SELECT * REPLACE (CAST(CAST(product_id AS BIGINT)//2 AS VARCHAR) AS product_id) FROM lines) l
    LEFT JOIN stock s ON l.user_id=s.user_id AND l.product_id=s.product_id"""))
def match_order_lines(spark, sf_dir):
    # Halved ids, so that some lines meet two items.
    half = "cast(cast({} as bigint) div 2 as string)"
    lines = fx.lines(spark, sf_dir).withColumn("product_id", F.expr(half.format("product_id")))
    inventory = fx.inventory(spark, sf_dir).withColumn("external_stock_id", F.expr(half.format("id")))
    return ev.match_order_lines(lines, inventory).select(
        "user_id", "order_id", "ln", "product_id", "quantity", "item_id", "error")


_IN_ORDER = "PARTITION BY user_id, external_stock_id ORDER BY ts, order_id, ln, delta"
_LEDGER = with_views("deltas inventory", f"""
    , sums AS (SELECT d.*, i.id AS item_id, i.quantity AS q0,
                      CAST(sum(delta) OVER ({_IN_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s
               FROM deltas d LEFT JOIN inventory i USING (user_id, external_stock_id))
    , lows AS (SELECT *, min(s) OVER ({_IN_ORDER} ROWS UNBOUNDED PRECEDING) AS m,
                      coalesce(min(s) OVER ({_IN_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS mp
               FROM sums)
    , ledger AS (SELECT user_id, external_stock_id, CAST(delta AS BIGINT) AS delta, ts, order_id, ln, item_id,
                        CAST(q0+s-delta-least(0,q0+mp) AS BIGINT) AS old_quantity,
                        CAST(q0+s-least(0,q0+m) AS BIGINT) AS new_quantity FROM lows)""")


@query(_LEDGER + """
    SELECT *, new_quantity<>old_quantity+delta AS clamped,
           CASE WHEN item_id IS NULL THEN 'Product not found in local inventory' END AS error FROM ledger""")
def stock_ledger(spark, sf_dir):
    return lg.stock_ledger(deltas(spark, sf_dir), fx.inventory(spark, sf_dir), DELTA_ORDER)


@query(_LEDGER + """
    , last AS (SELECT item_id, new_quantity FROM ledger WHERE item_id IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY ts DESC, order_id DESC, ln DESC, delta DESC)=1)
    SELECT i.* REPLACE (CAST(coalesce(l.new_quantity, i.quantity) AS INT) AS quantity)
    FROM inventory i LEFT JOIN last l ON i.id=l.item_id""")
def apply_deltas(spark, sf_dir):
    return lg.apply_deltas(fx.inventory(spark, sf_dir), deltas(spark, sf_dir), DELTA_ORDER)


@query(with_views("deltas inventory", """
    SELECT user_id, external_stock_id, CAST(delta AS BIGINT) AS delta, ts, order_id, ln, 'not_found' AS status
    FROM deltas d ANTI JOIN inventory i USING (user_id, external_stock_id)"""))
def unknown_deltas(spark, sf_dir):
    return lg.unknown_deltas(fx.inventory(spark, sf_dir), deltas(spark, sf_dir))


def events_applied(event_id, ts="ts"):
    """SQL of the lines of all acting events in order, with the item's stock after each."""
    return with_views("lines inventory", _ROUTE + f"""
    , l0 AS (SELECT user_id, product_id, CAST(CASE WHEN action='sell' THEN -quantity ELSE quantity END AS BIGINT) AS d,
            action, {ts} AS ts, order_id, {event_id} AS event_id,
            row_number() OVER (PARTITION BY order_id, user_id ORDER BY ln, product_id, quantity)-1 AS ln, quantity
            FROM routed WHERE action<>'ignored')
    , l1 AS (SELECT l0.*, i.quantity AS q0, sum(d) OVER (PARTITION BY l0.user_id, product_id
            ORDER BY ts, event_id, ln, l0.quantity ROWS UNBOUNDED PRECEDING) AS s
            FROM l0 LEFT JOIN inventory i ON i.user_id=l0.user_id AND i.external_stock_id=product_id
            WHERE product_id<>'0')
    , l2 AS (SELECT *, q0+s-least(0,q0+min(s) OVER (PARTITION BY user_id, product_id
            ORDER BY ts, event_id, ln, quantity ROWS UNBOUNDED PRECEDING)) AS q FROM l1)""")


_ORDER_AND_SELLER = "CAST(order_id AS VARCHAR)||'-'||CAST(user_id AS VARCHAR)"


# Events without an id, and ids that all sellers of an order share.
@query(events_applied(f"""CASE WHEN order_id%11=0 THEN 'unknown '||{_ORDER_AND_SELLER}
                          WHEN order_id%13=0 THEN CAST(order_id AS VARCHAR) ELSE {_ORDER_AND_SELLER} END""") + """
    SELECT event_id, user_id, action, count(*) FILTER (q0 IS NOT NULL) AS items_processed,
           count(*) FILTER (q0 IS NULL) AS failed, CAST(coalesce(sum(q),0) AS BIGINT) AS quantity_after,
           'processed' AS status
    FROM l2 GROUP BY event_id, user_id, action""")
def event_results(spark, sf_dir):
    # The nested events are derived once, as a feed would bring them.
    order = F.col("data.id")
    key = (F.when(order % 11 == 0, F.concat(F.lit("unknown "), "id")).when(order % 13 == 0, order.cast("string"))
           .otherwise(F.col("id")))
    events = cut(fx.order_events(spark, sf_dir).withColumn("event_key", key), "events")
    lines = ev.valid_order_lines(ev.explode_lines(ev.route_events(events)))
    applied = lg.stock_ledger(ev.line_deltas(lines), fx.inventory(spark, sf_dir), ev.LINE_ORDER)
    total = F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i.new_quantity)
    return ev.event_results(applied).select(
        "event_id", "user_id", "action", "items_processed", F.size("errors").cast("long").alias("failed"),
        total.alias("quantity_after"), "status")


@query(with_views("lines", """
    SELECT product_id AS id, min(ts) AS ts,
           arg_min(order_id, CAST(epoch(ts) AS BIGINT)*1000000000+order_id) AS order_id
    FROM lines GROUP BY product_id"""))
def dedupe_events(spark, sf_dir):
    retried = fx.lines(spark, sf_dir).select(
        F.col("product_id").alias("id"), "ts", "order_id",
        (F.unix_seconds("ts") * 1_000_000_000 + F.col("order_id")).alias("arrival"))
    return ev.dedupe_events(retried, arrival="arrival").drop("arrival")


def _pads_sql(byte):
    return (f"unhex(array_to_string(list_transform(range(1,65), lambda i: printf('%02x', "
            f"xor(CASE WHEN i<=length(webhook_secret) THEN unicode(webhook_secret[i]) ELSE 0 END, {byte}))),''))")


@query(with_views("settings", f"""
    , signed AS (SELECT e.event_id, e.props AS body, s.webhook_secret, e.event_id%5 AS kind,
            sha256({_pads_sql(92)} || unhex(sha256({_pads_sql(54)} || encode(e.props)))) AS digest
            FROM events e JOIN settings s ON s.user_id=e.user_id%100)
    SELECT event_id, CASE WHEN webhook_secret IS NOT NULL THEN digest END AS digest,
           CASE WHEN webhook_secret IS NULL THEN 'no_secret' WHEN kind=0 THEN 'unsigned' WHEN kind=1 THEN 'malformed'
                WHEN kind=2 THEN 'invalid' ELSE 'valid' END AS signature_status
    FROM signed"""))
def verify_signature(spark, sf_dir):
    pads = sig.signing_pads(fx.settings(spark, sf_dir))
    events = fx.table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 100).alias("user_id"), F.col("props").alias("body"))
    known, _ = sig.attach_secrets(events, pads)
    digest = sig.hmac_sha256(F.encode("body", "UTF-8"), F.col("inner_pad"), F.col("outer_pad"))
    kind = F.col("event_id") % 5
    signed = known.withColumn("digest", digest).withColumn(
        "signature", F.when(kind == 0, "").when(kind == 1, "%%%").when(kind == 2, F.base64(F.encode(F.lit("x"), "UTF-8")))
        .otherwise(F.base64(F.unhex("digest"))))
    return sig.verify_signature(signed).select("event_id", "digest", "signature_status")


@query(with_views("settings", """
    SELECT e.event_id, e.user_id, s.webhook_secret, s.user_id IS NOT NULL AS known
    FROM events e LEFT JOIN settings s ON e.user_id=s.user_id"""))
def attach_secrets(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events").select("event_id", "user_id")
    known, unknown = sig.attach_secrets(events, sig.signing_pads(fx.settings(spark, sf_dir)))
    return (known.select("event_id", "user_id", "webhook_secret", F.lit(True).alias("known"))
            .unionByName(unknown.select("event_id", "user_id", F.lit(None).cast("string").alias("webhook_secret"),
                                        F.lit(False).alias("known"))))
