"""The derived tables of ``stockline.fixtures`` as SQL, for the side-by-side check."""

from __future__ import annotations

from stockline.fixtures import CONDITIONS, FOILS, LANGUAGES, SIGNED


def _list(values: list[str]) -> str:
    return "[" + ",".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


KEY = "(l_suppkey*1000000000+l_partkey)"
_UUID = ("substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)"
         "||'-'||substr({h},21,12)")


def uuid_sql(number: str) -> str:
    return _UUID.format(h=f"lpad(lower(to_hex({number})),32,'0')")


def _price(shift: int) -> str:
    return f"CAST(100+(l_partkey*37+l_suppkey*11+{shift})%5000 AS INT)"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "inventory": ((), f"""
        SELECT {KEY} AS id, l_suppkey AS user_id, l_partkey AS blueprint_id,
               CAST({KEY} AS VARCHAR) AS external_stock_id,
               CAST(sum(l_quantity) AS INT) AS quantity, {_price(0)} AS price_cents,
               max(l_shipdate) AS updated_at
        FROM lineitem WHERE l_returnflag IN ('A','R') GROUP BY l_suppkey, l_partkey"""),
    "export": ((), f"""
        SELECT CASE WHEN (l_suppkey+l_partkey)%89<>0 THEN {KEY} END AS id, l_suppkey AS user_id,
               CASE WHEN l_partkey%97<>0 THEN l_partkey END AS blueprint_id,
               CAST(sum(l_quantity) AS INT) AS quantity, {_price(7)} AS price_cents, {KEY} AS seq
        FROM lineitem WHERE l_returnflag IN ('N','R') GROUP BY l_suppkey, l_partkey"""),
    "catalog": ((), """
        SELECT p_partkey*10+1 AS print_id, 'cards_prints' AS table_name, p_partkey AS blueprint_id, 1 AS priority
        FROM part WHERE split_part(p_type,' ',1) IN ('STANDARD','MEDIUM')
        UNION SELECT p_partkey*10+2, 'op_prints', p_partkey, 2 FROM part WHERE split_part(p_type,' ',1)='PROMO'
        UNION SELECT p_partkey*10+3, 'pk_prints', p_partkey, 3 FROM part
              WHERE split_part(p_type,' ',1)='SMALL' OR p_partkey%13=0
        UNION SELECT p_partkey*10+4, 'sealed_products', p_partkey, 4 FROM part
              WHERE split_part(p_type,' ',1)='LARGE' OR p_partkey%17=0"""),
    "resolved": (("catalog",), """
        SELECT blueprint_id, print_id, table_name FROM catalog
        QUALIFY row_number() OVER (PARTITION BY blueprint_id ORDER BY priority, print_id)=1"""),
    "lines": ((), f"""
        SELECT l_suppkey AS user_id, CAST({KEY} AS VARCHAR) AS product_id, CAST(l_quantity AS INT) AS quantity,
               o_orderkey AS order_id, o_orderdate AS ts, l_linenumber AS ln,
               CASE o_orderkey%4 WHEN 0 THEN 'order.update' WHEN 1 THEN 'order.destroy' ELSE 'order.create' END AS cause,
               CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'P' THEN 'canceled' ELSE 'pending' END AS state,
               CASE WHEN o_custkey%3=0 THEN 'paid' END AS previous_state
        FROM lineitem JOIN orders ON l_orderkey=o_orderkey"""),
    "deltas": (("lines",), """
        SELECT user_id, product_id AS external_stock_id,
               CASE WHEN cause='order.create' THEN -quantity ELSE quantity END AS delta, ts, order_id, ln
        FROM lines
        WHERE product_id<>'0' AND ((cause='order.create' AND state='paid')
           OR (cause='order.update' AND state='canceled') OR cause='order.destroy')"""),
    "props": ((), f"""
        SELECT p_partkey AS blueprint_id,
               '{{"condition":"'||({_list(CONDITIONS)})[p_partkey%12+1]||'","mtg_foil":'||({_list(FOILS)})[p_partkey%6+1]
               ||',"mtg_language":"'||({_list(LANGUAGES)})[p_partkey%5+1]||'","signed":'||({_list(SIGNED)})[p_partkey%4+1]
               ||',"cmc":3,"graded":true,"artist":"A'||CAST(p_partkey%60 AS VARCHAR)||'"}}' AS properties
        FROM part"""),
    "full_inventory": (("inventory", "props"), """
        SELECT id, user_id, i.blueprint_id, quantity, price_cents, properties,
               CASE WHEN i.blueprint_id%53<>0 THEN external_stock_id END AS external_stock_id,
               CASE WHEN i.blueprint_id%3=0 THEN 'first edition' END AS description,
               CASE WHEN i.blueprint_id%4=0 THEN 'shelf' END AS user_data_field,
               CASE WHEN i.blueprint_id%5<>0 THEN i.blueprint_id%5=1 END AS graded,
               updated_at AS created_at, updated_at
        FROM inventory i LEFT JOIN props p ON i.blueprint_id=p.blueprint_id"""),
    "full_export": (("export", "props"), """
        SELECT user_id, id, e.blueprint_id, quantity, price_cents,
               CASE WHEN (seq%1000000000)%2=0 THEN 'from export' END AS description,
               CAST(NULL AS VARCHAR) AS user_data_field,
               CASE WHEN (seq%1000000000)%4=0 THEN true END AS graded, properties AS properties_hash, seq
        FROM export e LEFT JOIN props p ON seq%1000000000=p.blueprint_id"""),
    "patches": ((), f"""
        SELECT item_id, user_id,
               CASE WHEN m%2=0 THEN CAST(m-2 AS INT) END AS quantity,
               CASE WHEN m%3=0 THEN CAST(500+m AS INT) END AS price_cents,
               CAST(NULL AS VARCHAR) AS description,
               CASE WHEN m%4=0 THEN '  ' WHEN m%4=1 THEN 'shelf' END AS user_data_field,
               CASE WHEN m=5 THEN true END AS graded,
               CASE WHEN card%20=0 THEN '{{"condition":"'||({_list(CONDITIONS)})[m%12+1]
                    ||'","signed":false,"artist":null}}' END AS properties
        FROM (SELECT {KEY} AS item_id, l_suppkey AS user_id, l_partkey AS card, max(l_linenumber) AS m
              FROM lineitem GROUP BY l_suppkey, l_partkey)"""),
    "purchases": ((), f"""
        SELECT CAST(l_orderkey AS VARCHAR)||'-'||CAST(l_linenumber AS VARCHAR)||'-'||CAST(l_partkey AS VARCHAR) AS request_id,
               l_orderkey AS order_id, {KEY} AS item_id, l_suppkey AS user_id, quantity, o_orderdate AS ts
        FROM (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CAST(sum(l_quantity) AS INT) AS quantity
              FROM lineitem GROUP BY ALL) JOIN orders ON l_orderkey=o_orderkey"""),
    "settings": ((), """
        SELECT s_suppkey AS user_id, s_acctbal>0 AS has_token,
               CASE WHEN s_suppkey%4<>0 THEN 'secret-'||CAST(s_suppkey AS VARCHAR) END AS webhook_secret,
               (['idle','initial_sync','active','error'])[s_suppkey%4+1] AS sync_status,
               CASE WHEN s_suppkey%3=0 THEN TIMESTAMP '2023-11-14 22:13:20' + to_seconds(s_suppkey) END AS last_sync_at,
               CASE WHEN s_suppkey%4=3 THEN 'Remote error' END AS last_error
        FROM supplier"""),
    "operations": ((), """
        SELECT o_orderkey AS operation_id, o_custkey AS user_id,
               CASE WHEN o_orderpriority LIKE '1%' THEN 'sync_delete' WHEN o_orderpriority LIKE '2%' THEN 'sync_update'
                    ELSE 'bulk_sync' END AS operation_type,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'pending' END AS status,
               CASE WHEN o_orderkey%5<>0 THEN CAST(o_orderkey%101 AS INT) END AS progress_percent,
               CASE WHEN o_orderkey%5<>0 THEN CAST(o_orderkey%7 AS INT) END AS processed,
               o_orderdate AS created_at
        FROM orders"""),
    "requests": ((), """
        SELECT event_id AS request_id, user_id, ts, event_type AS endpoint, value AS duration_s,
               CASE WHEN event_type='error' AND event_id%2=0 THEN 429 WHEN event_type='error' THEN 500
                    WHEN event_type='signup' AND event_id%5=0 THEN 404 ELSE 200 END AS status_code
        FROM events"""),
    "metric_events": ((), """
        SELECT event_type AS name, user_id%3 AS label, CAST(value AS DECIMAL(12,2)) AS value, ts, event_id AS seq
        FROM events"""),
    "status_events": ((), """
        SELECT o_custkey AS user_id, o_orderdate AS ts, o_orderkey AS seq,
               (['start','success','failure','suspend','remove','setup'])[o_orderkey%6+1] AS event,
               CASE WHEN o_orderkey%6=2 THEN 'error '||CAST(o_orderkey%10 AS VARCHAR) END AS error,
               CASE WHEN o_orderkey%6=5 THEN 'new-'||CAST(o_orderkey AS VARCHAR) END AS webhook_secret
        FROM orders"""),
    "outcomes": (("export", "resolved", "inventory"), """
        SELECT e.user_id, e.seq, e.id, e.blueprint_id, e.quantity, e.price_cents,
               CASE WHEN coalesce(e.id,0)=0 OR coalesce(e.blueprint_id,0)=0 THEN 'skip_invalid'
                    WHEN r.print_id IS NULL THEN 'skip_unmapped'
                    WHEN r.table_name='op_prints' THEN 'skip_excluded'
                    WHEN i.id IS NOT NULL THEN 'updated' ELSE 'created' END AS outcome
        FROM export e LEFT JOIN resolved r ON e.blueprint_id=r.blueprint_id
        LEFT JOIN inventory i ON i.user_id=e.user_id AND i.blueprint_id=e.blueprint_id
             AND i.external_stock_id=CAST(e.id AS VARCHAR)"""),
}


def with_views(names: str, body: str) -> str:
    """``WITH`` the named views and what they need; a body starting with a comma adds its own."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, text = VIEWS[name]
        for need in needs:
            add(need)
        clause = f"{name} AS ({text})"
        if clause not in ordered:
            ordered.append(clause)

    for name in names.split():
        add(name)
    return "WITH RECURSIVE " + ",\n".join(ordered) + "\n" + body
