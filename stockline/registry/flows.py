"""Registered queries: readers, writers and streams, on files that Spark derives from the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline import fixtures as fx
from stockline import schemas
from stockline.operators import edits as ed
from stockline.operators import events as ev
from stockline.operators import products as p
from stockline.functions.signature import signing_pads
from stockline.operators.ledger import stock_ledger as batch_ledger
from stockline.plans import jobs
from stockline.plans.order_flow import accept_events as accept, event_answers, event_deltas
from stockline.registry.bulk import outcomes
from stockline.registry.items import condition_sql
from stockline.registry.orders import events_applied
from stockline.registry.service import _BUCKET_WALK
from stockline.registry.views import uuid_sql, with_views
from stockline.session import cut, scratch_path, stream_session
from stockline.sources import readers as rd
from stockline.sources import writers as wr
from stockline.streaming import service as sv
from stockline.streaming import sinks
from stockline.streaming import stock as st

QUERIES = {}
# Rows that one task writes to export files.
FILE_ROWS = 1_000_000


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function
    return add


def _store(frame, label, fmt="parquet", partition=()):
    path = scratch_path(frame.sparkSession, label)
    _append(frame, path, fmt, partition)
    return path


def _append(frame, path, fmt="parquet", partition=()):
    writer = frame.write.mode("append").format(fmt)
    if fmt == "json":  # field names and ids come again in every line: a twentieth of the bytes
        writer = writer.option("compression", "gzip")
    (writer.partitionBy(*partition) if partition else writer).save(path)


def _export_rows(spark, sf_dir):
    return fx.full_export(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))


def _export_store(rows):
    """Exports of all sellers in files of about one size, a large seller's in several: with a folder a seller, the folders
    and not the rows would set the time, for the writer, the listing and the reader."""
    return _store(rows.drop("seq").hint("rebalance", F.col("user_id")), "export", "json")


def _export_files(spark, sf_dir):
    return _export_store(_export_rows(spark, sf_dir).withColumn("expansion_id", F.col("blueprint_id") % 50))


@query(with_views("full_export", """
    SELECT CAST(user_id AS VARCHAR) AS user_id, id, blueprint_id, quantity, price_cents, description, graded,
           json_extract_string(properties_hash,'$.condition') AS condition
    FROM full_export WHERE blueprint_id%50=7"""))
def read_export(spark, sf_dir):
    rows = rd.read_export(spark, _export_files(spark, sf_dir), expansion_id=7, multiline=False)
    return rows.select("user_id", "id", "blueprint_id", "quantity", "price_cents", "description", "graded",
                       F.get_json_object("properties_hash", "$.condition").alias("condition"))


@query(with_views("full_export", """
    , twice AS (SELECT *, 0 AS round FROM full_export
                UNION ALL SELECT * REPLACE (CAST(quantity+1 AS INT) AS quantity), 1 FROM full_export WHERE seq%3<>0)
    SELECT CAST(user_id AS VARCHAR) AS user_id, id, blueprint_id, quantity, price_cents, description, user_data_field,
           graded, properties_hash FROM twice
    QUALIFY row_number() OVER (PARTITION BY user_id, id ORDER BY round DESC, seq DESC)=1"""))
def read_export_all(spark, sf_dir):
    """Several files per seller, with products that come again in a later file."""
    # Written once: it is counted, sampled and dealt out.
    first = cut(_export_rows(spark, sf_dir), "first")
    again = first.where(F.col("seq") % 3 != 0).withColumn("quantity", F.col("quantity") + 1)
    rows = first.withColumn("round", F.lit(0)).unionByName(again.withColumn("round", F.lit(1)))
    files = max(8, -(-rows.count() // FILE_ROWS))
    placed = rows.repartitionByRange(files, "round", "seq").sortWithinPartitions("round", "seq")
    path = _store(placed.drop("round", "seq"), "export", "json")
    read = rd.read_export(spark, path, multiline=False)
    return p.last_write(read, ["user_id", "id"]).select(
        "user_id", "id", "blueprint_id", "quantity", "price_cents", "description", "user_data_field", "graded",
        "properties_hash")


@query(with_views("settings outcomes", """
    , counts AS (SELECT user_id, count(*) AS processed, count(*) FILTER (outcome='created') AS created,
                        count(*) FILTER (outcome='updated') AS updated, count(*) FILTER (outcome LIKE 'skip%') AS skipped
                 FROM outcomes GROUP BY user_id)
    , asked AS (SELECT *, has_token AND (user_id%8=0 OR sync_status NOT IN ('initial_sync','active')) AS allowed FROM settings)
    SELECT CAST(a.user_id AS VARCHAR) AS user_id, allowed,
           CASE WHEN NOT has_token THEN 'no token' WHEN NOT allowed THEN 'sync in progress: '||sync_status END AS reason,
           CASE WHEN allowed THEN 'completed' END AS operation_status,
           CASE WHEN allowed THEN coalesce(processed,0) END AS processed, CASE WHEN allowed THEN coalesce(created,0) END AS created,
           CASE WHEN allowed THEN coalesce(updated,0) END AS updated, CASE WHEN allowed THEN coalesce(skipped,0) END AS skipped,
           CASE WHEN allowed THEN 'active' ELSE sync_status END AS sync_status,
           CASE WHEN NOT allowed THEN last_error END AS last_error
    FROM asked a LEFT JOIN counts c ON c.user_id=a.user_id"""))
def import_lifecycle(spark, sf_dir):
    """Every seller asks for an import, from guard to completed operation."""
    export_path = _export_store(_export_rows(spark, sf_dir))
    catalog_path, inventory_path = scratch_path(spark, "catalog"), scratch_path(spark, "inventory")
    for name, frame in fx.catalog_tables(spark, sf_dir).items():
        frame.withColumn("blueprint_id", F.col("blueprint_id").cast("int")).write.parquet(f"{catalog_path}/{name}")
    wr.write_inventory(fx.full_inventory(spark, sf_dir).withColumn(
        "external_stock_id", F.col("id").cast("string")), inventory_path, 1)
    settings = fx.settings(spark, sf_dir).withColumns({
        "user_id": F.col("user_id").cast("string"), "updated_at": F.lit(None).cast("timestamp")})
    requests = settings.select("user_id", F.concat(F.lit("import-"), "user_id").alias("operation_id"),
                               (F.col("user_id").cast("long") % 8 == 0).alias("force"))
    done = jobs.run_requested_import(spark, requests, settings, spark.createDataFrame([], schemas.OPERATIONS),
                                     export_path, catalog_path, inventory_path, multiline=False)
    counts = ["processed", "created", "updated", "skipped"]
    operations = done.operations.select("operation_id", F.col("status").alias("operation_status"),
                                        *[f"operation_metadata.{c}" for c in counts])
    return (done.answers.join(operations, "operation_id", "left")
            .join(done.settings.select("user_id", "sync_status", "last_error"), "user_id")
            .select("user_id", "allowed", "reason", "operation_status", *counts, "sync_status", "last_error"))


def _stored_inventory(spark, sf_dir):
    path = scratch_path(spark, "inventory")
    wr.write_inventory(fx.full_inventory(spark, sf_dir), path, 1)
    return path


@query(with_views("full_export full_inventory resolved", """
    , changes AS (SELECT e.* FROM full_export e JOIN resolved r ON e.blueprint_id=r.blueprint_id
        WHERE e.id<>0 AND e.blueprint_id<>0 AND r.table_name<>'op_prints')
    SELECT i.id, true AS has_id, CAST(coalesce(i.user_id,c.user_id) AS VARCHAR) AS user_id,
           CAST(coalesce(i.blueprint_id,c.blueprint_id) AS INT) AS blueprint_id,
           CASE WHEN i.id IS NULL THEN CAST(c.id AS VARCHAR) ELSE i.external_stock_id END AS external_stock_id,
           coalesce(c.quantity,i.quantity) AS quantity, coalesce(c.price_cents,i.price_cents) AS price_cents, i.description
    FROM full_inventory i FULL JOIN changes c ON i.user_id=c.user_id AND i.blueprint_id=c.blueprint_id
         AND i.external_stock_id=CAST(c.id AS VARCHAR)"""))
def import_job(spark, sf_dir):
    """Import all exports from files into the stored inventory, then read it back; new items have ids of their own."""
    path, catalog_path = _stored_inventory(spark, sf_dir), scratch_path(spark, "catalog")
    for name, frame in fx.catalog_tables(spark, sf_dir).items():
        frame.withColumn("blueprint_id", F.col("blueprint_id").cast("int")).write.parquet(f"{catalog_path}/{name}")
    export_path = _export_store(_export_rows(spark, sf_dir))
    known = wr.last_id(spark, path)
    jobs.run_import(spark, export_path, catalog_path, path, multiline=False)
    rows = wr.read_snapshot(spark, path, schemas.INVENTORY)
    return rows.select(F.when(F.col("id") <= known, F.col("id")).alias("id"), F.col("id").isNotNull().alias("has_id"),
                       "user_id", "blueprint_id", "external_stock_id", "quantity", "price_cents", "description")


@query(with_views("full_inventory", """
    SELECT id, CAST(user_id AS VARCHAR) AS user_id,
           CASE WHEN user_id%2=0 AND blueprint_id%5=0 THEN CAST(quantity+3 AS INT) ELSE quantity END AS quantity,
           CASE WHEN user_id%2=0 AND blueprint_id%5=0 THEN 77 ELSE price_cents END AS price_cents,
           CASE WHEN user_id%2=0 AND blueprint_id%10=0 THEN 'new' ELSE description END AS description
    FROM full_inventory"""))
def edit_job(spark, sf_dir):
    """Edit items of half the sellers in the stored inventory, in two patches for some, then read it back."""
    path = _stored_inventory(spark, sf_dir)
    items = wr.read_snapshot(spark, path, schemas.INVENTORY).where(
        (F.col("user_id").cast("long") % 2 == 0) & (F.col("blueprint_id") % 5 == 0)).select(
        F.col("id").alias("item_id"), "user_id", "blueprint_id", "quantity")
    none = {c: F.lit(None).cast(kind) for c, kind in (("user_data_field", "string"), ("graded", "boolean"), ("properties", "string"))}
    first = items.withColumns({"quantity": F.col("quantity") + 3, "price_cents": F.lit(77), "seq": F.lit(1),
                               "description": F.lit(None).cast("string"), **none})
    second = items.where(F.col("blueprint_id") % 10 == 0).withColumns({
        "quantity": F.lit(None).cast("int"), "price_cents": F.lit(None).cast("int"), "seq": F.lit(2),
        "description": F.lit("new"), **none})
    jobs.run_edits(spark, cut(first.unionByName(second), "patches"), path, scratch_path(spark, "outbox"))
    return wr.read_snapshot(spark, path, schemas.INVENTORY).select("id", "user_id", "quantity", "price_cents", "description")


@query(with_views("full_inventory", """
    SELECT id, CAST(user_id AS VARCHAR) AS user_id, quantity, false AS sent
    FROM full_inventory WHERE NOT (user_id%3=0 AND blueprint_id%7=0)
    UNION ALL SELECT id, CAST(user_id AS VARCHAR), NULL, true FROM full_inventory
    WHERE user_id%3=0 AND blueprint_id%7=0 AND external_stock_id IS NOT NULL"""))
def delete_job(spark, sf_dir):
    """Delete items of a third of the sellers from the stored inventory; what is left, and the deletes sent out."""
    path, outbox = _stored_inventory(spark, sf_dir), scratch_path(spark, "outbox")
    wanted = wr.read_snapshot(spark, path, schemas.INVENTORY).where(
        (F.col("user_id").cast("long") % 3 == 0) & (F.col("blueprint_id") % 7 == 0)).select(
        "user_id", F.col("id").alias("item_id"))
    jobs.run_deletes(spark, cut(wanted, "requests"), path, outbox)
    left = wr.read_snapshot(spark, path, schemas.INVENTORY).select("id", "user_id", "quantity", F.lit(False).alias("sent"))
    sent = spark.read.schema("user_id string, item_id long, product_id long").json(f"{outbox}/delete=2")
    return left.unionByName(sent.select(F.col("product_id").alias("id"), "user_id", F.lit(None).cast("int").alias("quantity"),
                                        F.lit(True).alias("sent")))


@query(with_views("catalog", "SELECT print_id, table_name, CAST(blueprint_id AS INT) AS blueprint_id, priority FROM catalog"))
def read_catalog(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    for name, frame in fx.catalog_tables(spark, sf_dir).items():
        frame.withColumn("blueprint_id", F.col("blueprint_id").cast("int")).write.parquet(f"{path}/{name}")
    return rd.read_catalog(spark, path)


def _domain_inventory(spark, sf_dir):
    return fx.full_inventory(spark, sf_dir).withColumns({
        "user_id": fx.uuid_text(F.col("user_id")), "blueprint_id": F.col("blueprint_id").cast("int")})


_DOMAIN_SQL = with_views("full_inventory", f"""
    SELECT id, {uuid_sql('user_id')} AS user_id, CAST(blueprint_id AS INT) AS blueprint_id, quantity, price_cents,
           properties, external_stock_id, description, user_data_field, graded, created_at, updated_at
    FROM full_inventory""")


@query(_DOMAIN_SQL)
def read_inventory(spark, sf_dir):
    return rd.read_inventory(spark, _store(_domain_inventory(spark, sf_dir), "inventory"))


@query(with_views("settings", f"""
    SELECT {uuid_sql('user_id')} AS user_id, has_token, webhook_secret, sync_status, last_sync_at, last_error
    FROM settings"""))
def read_settings(spark, sf_dir):
    rows = fx.settings(spark, sf_dir).withColumn("user_id", fx.uuid_text(F.col("user_id")))
    return rd.read_settings(spark, _store(rows, "settings")).drop("created_at", "updated_at")


@query(with_views("operations", f"""
    SELECT {uuid_sql('user_id')} AS user_id, CAST(operation_id AS VARCHAR) AS operation_id, operation_type, status,
           progress_percent, created_at FROM operations"""))
def read_operations(spark, sf_dir):
    progress = "operation_metadata.progress_percent"
    rows = fx.operations(spark, sf_dir).select(
        fx.uuid_text(F.col("user_id")).alias("user_id"), F.col("operation_id").cast("string").alias("operation_id"),
        "operation_type", "status", F.struct(F.col(progress).alias("progress_percent")).alias("operation_metadata"),
        "created_at")
    read = rd.read_operations(spark, _store(rows, "operations"))
    return read.select("user_id", "operation_id", "operation_type", "status", progress, "created_at")


@query(_DOMAIN_SQL.rsplit("SELECT id, ", 1)[0] + "SELECT * REPLACE (quantity+1 AS quantity) FROM (SELECT id, "
       + _DOMAIN_SQL.rsplit("SELECT id, ", 1)[1] + ")")
def write_inventory(spark, sf_dir):
    path = scratch_path(spark, "snapshots")
    first = _domain_inventory(spark, sf_dir)
    wr.write_inventory(first, path, 1)
    current = wr.read_snapshot(spark, path, schemas.INVENTORY)
    wr.write_inventory(current.withColumn("quantity", F.col("quantity") + 1), path, 2)
    return wr.read_snapshot(spark, path, schemas.INVENTORY)


# The feed's events: those of some orders have no id (and a time of their own, as nothing else puts them in order), and
# the sellers of some orders share one id.
_ID = """CASE WHEN order_id%11=0 THEN 'unknown' WHEN order_id%13=0 THEN CAST(order_id AS VARCHAR)
         ELSE CAST(order_id AS VARCHAR)||'-'||CAST(user_id AS VARCHAR) END"""
_TS = "CASE WHEN order_id%11=0 THEN ts+to_milliseconds(order_id) ELSE ts END"
_EVENTS_APPLIED = events_applied(_ID, _TS)


def _envelope(spark, sf_dir, retries=False):
    order = F.col("data.id")
    ts = F.when(order % 11 == 0, F.timestamp_millis(F.unix_millis("ts") + order)).otherwise(F.col("ts"))
    events = fx.order_events(spark, sf_dir).withColumns({
        "id": F.when(order % 13 == 0, order.cast("string")).otherwise(F.col("id")), "ts": ts})
    events = events.withColumn("id", F.when(order % 11 != 0, F.col("id")))
    if retries:
        copies = F.when(F.col("id").isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        events = events.withColumn("_copy", F.explode(copies))
    body = F.to_json(F.struct("id", "cause", "mode", "data"))
    return events.select(F.col("ts").alias("received_at"), F.lit(None).cast("string").alias("user_id"),
                         F.lit("").alias("signature"), body.alias("body"))


def _event_files(spark, sf_dir, retries=False):
    return _store(_envelope(spark, sf_dir, retries), "events", "json")


def _dealt(rows, part, label):
    """The parts of a table by the number ``part``, in its order. The table is derived and written once, by all tasks."""
    numbered = rows.withColumn("_part", part.cast("int")).where(F.col("_part").isNotNull())
    dealt = rows.sparkSession.read.schema(numbered.schema).parquet(_store(numbered, label, partition=["_part"]))
    numbers = sorted(row[0] for row in dealt.select("_part").distinct().collect())
    return [dealt.where(F.col("_part") == k).drop("_part") for k in numbers]


@query(with_views("lines", f"""
    SELECT {_ID} AS id, {_TS} AS ts, cause, state, {uuid_sql('user_id')} AS seller, CAST(count(*) AS INT) AS items,
           CAST(sum(quantity) AS BIGINT) AS quantity, 1::BIGINT AS of_its_key
    FROM lines GROUP BY order_id, user_id, ts, cause, state"""))
def read_order_events(spark, sf_dir):
    events = rd.read_order_events(spark, _event_files(spark, sf_dir), stream=False)
    quantity = F.aggregate("data.order_items", F.lit(0).cast("long"), lambda a, i: a + i.quantity)
    shown = events.select("event_key", "id", "ts", "cause", "data.state", F.col("data.seller.id").alias("seller"),
                          F.size("data.order_items").alias("items"), quantity.alias("quantity"))
    # Events with the same key and seller: every one has a key of its own, with or without an id.
    same = F.count(F.lit(1)).over(Window.partitionBy("event_key", "seller"))
    return shown.where(F.col("seller").isNotNull()).withColumn("of_its_key", same).drop("event_key")


@query("""
    SELECT CASE WHEN event_id%50<>0 THEN 'm'||CAST(event_id AS VARCHAR) END AS message,
           CASE WHEN event_id%50<>0 THEN CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END END AS level,
           CASE WHEN event_id%50<>0 THEN value END AS duration_seconds,
           CASE WHEN event_id%50<>0 THEN date_trunc('second', ts) END AS logged_at,
           CASE WHEN event_id%50<>0 THEN CAST(regexp_extract(props,'[0-9]+') AS INT) END AS k,
           CASE WHEN event_id%50=0 THEN 'broken '||CAST(event_id AS VARCHAR) END AS corrupt_line FROM events""")
def read_service_logs(spark, sf_dir):
    events = fx.table(spark, sf_dir, "events")
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message"),
        F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO").alias("level"),
        F.col("value").alias("duration_seconds"), F.from_json("props", "k int").alias("data")))
    broken = F.concat(F.lit("broken "), F.col("event_id").cast("string"))
    text = events.select(F.when(F.col("event_id") % 50 == 0, broken).otherwise(line).alias("value"))
    logs = rd.read_service_logs(spark, _store(text, "logs", "text"))
    return logs.select("message", "level", "duration_seconds", "logged_at",
                       F.get_json_object("data", "$.k").cast("int").alias("k"), "corrupt_line")


@query(with_views("full_inventory", f"""
    SELECT user_id, id AS item_id, CAST(price_cents AS DOUBLE)/100.0 AS price,
           {condition_sql("json_extract_string(properties,'$.condition')")} AS condition
    FROM full_inventory WHERE external_stock_id IS NOT NULL"""))
def write_outbox(spark, sf_dir):
    path = scratch_path(spark, "outbox")
    wr.write_outbox(wr.update_outbox(ed.build_update_payload(fx.full_inventory(spark, sf_dir))), path)
    return spark.read.schema("user_id long, item_id long, body string").json(path).select(
        "user_id", "item_id", F.get_json_object("body", "$.price").cast("double").alias("price"),
        F.get_json_object("body", "$.properties.condition").alias("condition"))


@query(with_views("full_inventory", """
    SELECT user_id, id AS item_id, CASE WHEN blueprint_id%9<>0 THEN id END AS product_id,
           CASE WHEN blueprint_id%9=0 THEN 'not a product id: x'||external_stock_id END AS error
    FROM full_inventory WHERE external_stock_id IS NOT NULL"""))
def delete_outbox(spark, sf_dir):
    stock = F.col("external_stock_id")
    items = fx.full_inventory(spark, sf_dir).withColumn(
        "external_stock_id", F.when(F.col("blueprint_id") % 9 == 0, F.concat(F.lit("x"), stock)).otherwise(stock))
    return wr.delete_outbox(items)


@query(with_views("inventory export", """
    SELECT i.user_id, i.id AS product_id, CASE WHEN e.quantity<=i.quantity THEN 'delete' ELSE 'increment' END AS action,
           CASE WHEN e.quantity>i.quantity THEN '{"delta_quantity":-'||CAST(i.quantity AS VARCHAR)||'}' END AS body
    FROM inventory i JOIN export e ON e.id=i.id"""))
def increment_outbox(spark, sf_dir):
    remote = fx.export(spark, sf_dir).select("id", F.col("quantity").alias("remote_quantity"))
    moves = fx.inventory(spark, sf_dir).join(remote, "id").withColumn("delta", -F.col("quantity"))
    return wr.increment_outbox(moves)


@query(with_views("full_inventory", """
    SELECT id AS item_id, user_id, blueprint_id, CAST(price_cents AS DOUBLE)/100.0 AS price, quantity, description, graded
    FROM full_inventory WHERE external_stock_id IS NULL"""))
def create_outbox(spark, sf_dir):
    new = fx.full_inventory(spark, sf_dir).where(F.col("external_stock_id").isNull())
    body = F.from_json("body", "blueprint_id long, price double, quantity int, description string, graded boolean")
    return wr.create_outbox(new).select("item_id", "user_id", body.alias("b")).select("item_id", "user_id", "b.*")


@query(with_views("inventory", """
    SELECT user_id, batch, count(*) AS records, min(id) AS first_item, max(id) AS last_item
    FROM (SELECT user_id, id, (row_number() OVER (PARTITION BY user_id ORDER BY id)-1)//100 AS batch FROM inventory)
    GROUP BY user_id, batch"""))
def batch_outbox(spark, sf_dir):
    records = fx.inventory(spark, sf_dir).select(
        "user_id", F.col("id").alias("item_id"), F.to_json(F.struct("quantity")).alias("body"))
    return wr.batch_outbox(records).select(
        "user_id", "batch", "records", F.element_at("products", 1)["item_id"].alias("first_item"),
        F.element_at("products", -1)["item_id"].alias("last_item"))


@query(with_views("inventory operations", f"""
    SELECT id, quantity, CAST(NULL AS VARCHAR) AS description, CAST(NULL AS BOOLEAN) AS graded, CAST(NULL AS INT) AS progress
    FROM inventory UNION ALL SELECT operation_id, NULL, NULL, NULL, progress_percent FROM operations"""))
def evolve_schema(spark, sf_dir):
    old = fx.inventory(spark, sf_dir).select("id", "quantity", "updated_at")
    items = wr.evolve_schema(old, schemas.INVENTORY)
    ops = fx.operations(spark, sf_dir).select(
        F.col("operation_id").alias("id"), F.struct(F.col("operation_metadata.progress_percent"))
        .cast("struct<progress_percent: int>").alias("metadata"))
    renamed = wr.evolve_schema(ops, "id long, operation_metadata struct<progress_percent: int>, completed_at timestamp")
    return items.select("id", "quantity", "description", "graded", F.lit(None).cast("int").alias("progress")).unionByName(
        renamed.select("id", F.lit(None).cast("int").alias("quantity"), F.lit(None).cast("string").alias("description"),
                       F.lit(None).cast("boolean").alias("graded"),
                       F.col("operation_metadata.progress_percent").alias("progress")))


# --- streams ----------------------------------------------------------------------------------

_LEDGER = _EVENTS_APPLIED + f"""
    SELECT {uuid_sql('user_id')} AS user_id, event_id, product_id AS external_stock_id, CAST(ln AS INT) AS ln, d AS delta,
           CAST(q AS BIGINT) AS new_quantity,
           CASE WHEN q0 IS NULL THEN 'Product not found in local inventory' END AS error FROM l2"""


def _ledger_rows(spark, path):
    name = F.when(F.col("event_id").startswith("unknown "), "unknown").otherwise(F.col("event_id"))
    return spark.read.parquet(f"{path}/ledger").select(
        "user_id", name.alias("event_id"), "external_stock_id", "ln", "delta", "new_quantity", "error")


@query(_LEDGER)
def stream_stock_ledger(spark, sf_dir):
    events = st.dedupe_stream(rd.read_order_events(stream_session(spark), _event_files(spark, sf_dir, retries=True)))
    out, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "ledger-checkpoint")
    st.stream_stock_ledger(event_deltas(events), _domain_inventory_all(spark, sf_dir), out, checkpoint).awaitTermination()
    return _ledger_rows(spark, out)


@query(_LEDGER)
def stock_ledger_triggers(spark, sf_dir):
    """The same in a trigger per year, over small buckets and runs that are merged two by two."""
    session, inventory, path = stream_session(spark), _domain_inventory_all(spark, sf_dir), scratch_path(spark, "events")
    out, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "ledger-checkpoint")
    # One year after another, as a feed brings them: the stream goes on where it was and takes a year as one trigger.
    for year in _dealt(_envelope(spark, sf_dir), F.year("received_at"), "envelope"):
        _append(year, path, "json")
        st.stream_stock_ledger(event_deltas(rd.read_order_events(session, path)), inventory, out, checkpoint,
                               bucket_items=2000, fan=2, levels=2).awaitTermination()
    return _ledger_rows(spark, out)


@query(_EVENTS_APPLIED + """
    , last AS (SELECT user_id, product_id, q FROM l2 WHERE q0 IS NOT NULL
               QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY ts DESC, event_id DESC, ln DESC, quantity DESC)=1)
    SELECT i.id, CAST(coalesce(q, quantity) AS INT) AS quantity FROM inventory i
    LEFT JOIN last l ON l.user_id=i.user_id AND l.product_id=i.external_stock_id""")
def settled_inventory(spark, sf_dir):
    events = st.dedupe_stream(rd.read_order_events(stream_session(spark), _event_files(spark, sf_dir), max_files_per_trigger=100))
    inventory = _domain_inventory_all(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "ledger"), scratch_path(spark, "ledger-checkpoint")
    st.stream_stock_ledger(event_deltas(events), inventory, out, checkpoint).awaitTermination()
    return st.settled_inventory(inventory, out).select("id", "quantity")


def _domain_inventory_all(spark, sf_dir):
    return cut(fx.inventory(spark, sf_dir).withColumn("user_id", fx.uuid_text(F.col("user_id"))), "inventory")


@query(with_views("lines", f"""
    SELECT id, ts FROM (SELECT DISTINCT order_id, user_id, {_ID} AS id, {_TS} AS ts FROM lines)"""))
def dedupe_stream(spark, sf_dir):
    events = st.dedupe_stream(rd.read_order_events(stream_session(spark), _event_files(spark, sf_dir, retries=True)))
    out, checkpoint = scratch_path(spark, "deduped"), scratch_path(spark, "deduped-checkpoint")
    sinks.run_available(events.select("id", "ts"), out, checkpoint)
    return spark.read.schema("id string, ts timestamp").parquet(out)


_ALERTS = with_views("requests", """
    , w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS requests,
            count(*) FILTER (status_code>=500) AS errors, count(*) FILTER (status_code=429) AS throttles
            FROM requests GROUP BY 1)
    , a AS (SELECT window_start, window_start+INTERVAL 1 HOUR AS window_end, requests, errors, throttles,
            CAST(errors AS DOUBLE)/requests>0.1 AS error_alert, throttles>2 AS throttle_alert FROM w)
    SELECT * FROM a WHERE error_alert OR throttle_alert""")


@query(_ALERTS)
def alert_windows(spark, sf_dir):
    return sv.alert_windows(fx.requests(spark, sf_dir), "1 hour", None, 0.1, 2)


def _reported(rows, spread, report, label, triggers=5):
    """Keep a report of a table that comes in parts, each with rows of all times, trigger by trigger, and read it."""
    session, path = stream_session(rows.sparkSession), scratch_path(rows.sparkSession, label)
    out, checkpoint = scratch_path(session, label), scratch_path(session, f"{label}-checkpoint")
    for part in _dealt(rows, F.pmod(spread, F.lit(triggers)), label):
        _append(part, path)
        stream = session.readStream.schema(rows.schema).parquet(path)
        sv.run_report(stream, report, out, checkpoint).awaitTermination()
    return sv.report_rows(session, rows.schema, report, out)


@query(_ALERTS)
def stream_alert_windows(spark, sf_dir):
    """In five triggers of which each brings rows of all times, so that most rows are late."""
    return _reported(fx.requests(spark, sf_dir), F.col("request_id"), sv.alert_report("1 hour", None, 0.1, 2), "alerts")


@query("""
    SELECT event_type AS name, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, max(value) AS peak FROM events
    WHERE event_type IN ('view','click') GROUP BY 1, 2 HAVING max(value)>CASE event_type WHEN 'view' THEN 20 ELSE 50 END""")
def gauge_alerts(spark, sf_dir):
    gauges = fx.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("ts"))
    return sv.gauge_alerts(gauges, {"view": 20, "click": 50})


_OUTAGES = with_views("requests", """
    , f AS (SELECT endpoint, ts, request_id, CASE WHEN ts-lag(ts) OVER w<INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s
            FROM requests WHERE status_code>=400 AND status_code<>429 WINDOW w AS (PARTITION BY endpoint ORDER BY ts, request_id))
    , g AS (SELECT *, sum(s) OVER (PARTITION BY endpoint ORDER BY ts, request_id) AS session FROM f)
    SELECT endpoint, count(*) AS failures, min(ts) AS started_at, max(ts) AS ended_at FROM g
    GROUP BY endpoint, session HAVING count(*)>=3""")


@query(_OUTAGES)
def outage_windows(spark, sf_dir):
    return sv.outage_windows(fx.requests(spark, sf_dir), ["endpoint"], 1800, 3).drop("opened_at")


@query(_OUTAGES)
def stream_outage_windows(spark, sf_dir):
    """In five triggers of which each brings failures of all times: stretches grow together as rows come in."""
    return _reported(fx.requests(spark, sf_dir), F.col("request_id"), sv.outage_report(["endpoint"], 1800, 3),
                     "outages").drop("opened_at")


_METRICS = with_views("outcomes", """
    SELECT time_bucket(INTERVAL 1 MINUTE, make_timestamp(1700000000000000+(seq%1000)*1000000)) AS window_start,
           'bulk_sync' AS operation_type, CASE WHEN outcome LIKE 'skip%' THEN 'skipped' ELSE outcome END AS action,
           count(*) AS total FROM outcomes GROUP BY ALL""")


def _timed_outcomes(spark, sf_dir):
    return outcomes(spark, sf_dir).select(
        F.timestamp_seconds(F.col("seq") % 1000 + 1_700_000_000).alias("ts"), F.lit("bulk_sync").alias("operation_type"),
        "outcome")


@query(_METRICS)
def sync_metrics(spark, sf_dir):
    return sv.sync_metrics(_timed_outcomes(spark, sf_dir))


@query(_METRICS)
def stream_sync_metrics(spark, sf_dir):
    return _reported(_timed_outcomes(spark, sf_dir), F.xxhash64("ts", "outcome"), sv.sync_report(), "metrics")


@query(_BUCKET_WALK + """
    SELECT user_id, request_id, allowed,
           CASE WHEN NOT allowed THEN CAST(start+21600000000-t AS DOUBLE)/1000000.0 END AS wait_seconds FROM walk""")
def stream_throttle_audit(spark, sf_dir):
    requests = fx.requests(spark, sf_dir)
    requests = stream_session(spark).readStream.schema(requests.schema).parquet(_store(requests, "requests"))
    stream = sv.stream_throttle_audit(requests, 3, 21_600)
    out, checkpoint = scratch_path(spark, "audit"), scratch_path(spark, "audit-checkpoint")
    sinks.run_available(stream, out, checkpoint)
    return spark.read.schema(stream.schema).parquet(out)


@query(with_views("lines settings", f"""
    , e AS (SELECT DISTINCT order_id, user_id, {_ID} AS id FROM lines)
    SELECT id,
           CASE WHEN order_id%5=0 THEN NULL WHEN order_id%5 IN (1,2) OR s.user_id IS NULL THEN NULL
                WHEN webhook_secret IS NULL THEN 'no_secret' ELSE 'unsigned' END AS signature_status,
           CASE WHEN order_id%5=0 THEN NULL WHEN order_id%5=1 THEN 'Invalid user_id format: nobody'
                WHEN order_id%5=2 OR s.user_id IS NULL THEN 'User not found in sync settings' END AS message
    FROM e LEFT JOIN settings s ON s.user_id=e.user_id"""))
def accept_events(spark, sf_dir):
    feed = rd.read_order_events(spark, _event_files(spark, sf_dir), stream=False)
    order = F.col("data.id")
    sent = feed.withColumn("user_id", F.when(order % 5 == 1, "nobody").when(order % 5 == 2, fx.uuid_text(order + 1_000_000))
                           .when(order % 5 > 2, F.upper("data.seller.id")))
    settings = fx.settings(spark, sf_dir).withColumn("user_id", fx.uuid_text(F.col("user_id")))
    accepted, rejected = accept(sent.select("id", "user_id", "signature", "body"), signing_pads(settings))
    return accepted.select("id", "signature_status", F.lit(None).cast("string").alias("message")).unionByName(
        rejected.select("id", F.lit(None).cast("string").alias("signature_status"), "message"))


@query(_EVENTS_APPLIED + """
    , done AS (SELECT order_id, user_id, count(*) FILTER (q0 IS NOT NULL) AS items_processed,
                      count(*) FILTER (q0 IS NULL) AS failed, CAST(coalesce(sum(q),0) AS BIGINT) AS quantity_after
               FROM l2 GROUP BY order_id, user_id)
    , e AS (SELECT DISTINCT order_id, user_id, action, cause FROM routed)
    SELECT """ + _ID.replace("user_id", "e.user_id").replace("order_id", "e.order_id") + """ AS webhook_id, e.order_id,
           CASE WHEN e.action='ignored' THEN 'ignored' ELSE 'processed' END AS status,
           CASE WHEN e.action='restore' THEN 'restore_quantities' END AS action,
           CASE WHEN e.action<>'ignored' THEN coalesce(items_processed,0) END AS items_processed,
           coalesce(failed,0) AS failed, coalesce(quantity_after,0) AS quantity_after
    FROM e LEFT JOIN done ON done.order_id=e.order_id AND done.user_id=e.user_id""")
def order_flow(spark, sf_dir):
    """The whole way of an event in batch: feed, seller, route, lines, ledger, answer."""
    read = rd.read_order_events(spark, _event_files(spark, sf_dir, retries=True), stream=False)
    # The text as received is only needed to check signatures; without it a copy of the feed is a third as large.
    feed = cut(ev.dedupe_events(read.drop("signature", "body", "mode")), "feed")
    # Written once: the ledger reads its changes several times, and they come out of a feed with checks of every id.
    changes = cut(event_deltas(feed), "changes")
    applied = batch_ledger(changes, _domain_inventory_all(spark, sf_dir), ev.LINE_ORDER)
    answers = event_answers(feed, ev.event_results(applied))
    total = F.coalesce(F.aggregate("items", F.lit(0).cast("long"), lambda a, i: a + i.new_quantity), F.lit(0))
    return answers.select("webhook_id", "order_id", "status", "action", "items_processed",
                          F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("failed"),
                          total.alias("quantity_after"))
