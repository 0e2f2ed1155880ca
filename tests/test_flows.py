import json
import random

from pyspark.sql import functions as F

from stockline import schemas
from stockline.operators import events as ev
from stockline.operators import operations as op
from stockline.operators.ledger import stock_ledger
from stockline.plans import bulk, jobs
from stockline.plans import reconcile as rc
from stockline.plans.order_flow import event_answers, event_deltas
from stockline.sources import readers as rd
from stockline.sources import writers as wr
from stockline.streaming import service as sv
from stockline.streaming import sinks
from stockline.streaming import stock as st

USER = "db24fb13-ec73-49b8-932c-f0043dd47e86"


def test_export_arrays(spark, tmp_path):
    folder = tmp_path / f"user_id={USER}"
    folder.mkdir()
    products = [{"id": 1, "blueprint_id": 230018, "quantity": 5, "price_cents": 1600,
                 "properties_hash": {"signed": False, "condition": "Near Mint"}, "name_en": "x"},
                {"id": 2, "blueprint_id": 2, "expansion_id": 9}, {"id": None, "blueprint_id": 0}]
    (folder / "export.json").write_text(json.dumps(products, indent=1))
    rows = rd.read_export(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r.id for r in rows] == [1, 2, None] and {r.user_id for r in rows} == {USER}
    assert json.loads(rows[0].properties_hash) == products[0]["properties_hash"]
    assert [r.id for r in rd.read_export(spark, str(tmp_path), expansion_id=9).collect()] == [2]
    assert rd.read_export(spark, str(tmp_path), blueprint_id=0).count() == 3


def _inventory(spark, rows):
    return spark.createDataFrame(rows, "id long, user_id string, blueprint_id long, quantity int, price_cents int, "
                                       "properties string, external_stock_id string, description string, "
                                       "user_data_field string, graded boolean, created_at timestamp, updated_at timestamp")


def test_bulk_sync_rules(spark):
    inventory = _inventory(spark, [
        (1, "u", 10, 1, 1, "{}", "100", "keep", "keep", True, None, None),
        (2, "u", 11, 1, 1, "{}", None, None, None, None, None, None),
        (3, "u", 12, 7, 7, "{}", "300", None, None, None, None, None)])
    export = spark.createDataFrame(
        [("u", 100, 10, 5, 50, '{"a":1}', 1), ("u", 100, 10, 6, 60, None, 2), ("u", 200, 11, None, None, None, 3),
         ("u", 0, 10, 1, 1, None, 4), ("u", 400, 13, 1, 1, None, 5), ("u", 500, 99, 1, 1, None, 6)],
        "user_id string, id long, blueprint_id long, quantity int, price_cents int, properties_hash string, seq long")
    resolved = spark.createDataFrame([(10, 1, "cards_prints"), (11, 2, "pk_prints"), (13, 3, "op_prints")],
                                     "blueprint_id long, print_id long, table_name string")
    after = bulk.bulk_sync(export, resolved, inventory, F.current_timestamp())
    rows = {(r.blueprint_id, r.external_stock_id): r for r in after.collect()}
    assert len(rows) == 4
    # The last row of a repeated key wins; texts and grading of a known item stay.
    updated = rows[(10, "100")]
    assert (updated.id, updated.quantity, updated.price_cents, updated.properties) == (1, 6, 60, "{}")
    assert updated.description == "keep" and updated.updated_at and updated.created_at is None
    created = rows[(11, "200")]
    assert (created.id, created.quantity, created.price_cents, created.graded) == (None, 0, 0, None)
    assert rows[(12, "300")].quantity == 7 and rows[(11, None)].id == 2
    outcomes = sorted(r.outcome for r in bulk.classify_export(export, resolved, inventory).collect())
    assert outcomes == ["created", "skip_excluded", "skip_invalid", "skip_unmapped", "updated"]


def test_reconcile_rules(spark):
    inventory = _inventory(spark, [
        (1, "u", 10, 1, 1, "{}", "100", "old", "old", True, None, None),
        (2, "u", 11, 1, 1, "{}", "200", None, None, None, None, None),
        (3, "u", 12, 1, 1, "{}", "200", None, None, None, None, None),
        (4, "u", 12, 9, 9, "{}", "900", None, None, None, None, None)])
    export = spark.createDataFrame(
        [("u", 100, 99, 5, 50, None, None, None, None, 1), ("u", 200, 11, 5, 5, None, None, None, None, 2),
         ("u", 300, 13, 3, 3, "d", None, True, "{}", 3), ("u", 400, 98, 1, 1, None, None, None, None, 4),
         ("u", 500, None, 1, 1, None, None, None, None, 5), ("u", None, 13, 1, 1, None, None, None, None, 6)],
        "user_id string, id long, blueprint_id long, quantity int, price_cents int, description string, "
        "user_data_field string, graded boolean, properties_hash string, seq long")
    resolved = spark.createDataFrame([(13, 3, "op_prints")], "blueprint_id long, print_id long, table_name string")
    outcomes = rc.reconcile_outcomes(export, resolved, inventory)
    errors = {r.product_id: r.error for r in rc.reconcile_errors(outcomes).collect()}
    assert errors == {"200": "ambiguous_match", "400": "Blueprint 98 not found in mapping",
                      "500": "Blueprint None not found in mapping", None: "Product id missing"}
    after = {r.external_stock_id: r for r in rc.reconcile(outcomes, inventory, F.current_timestamp()).collect()}
    assert (after["100"].quantity, after["100"].description, after["100"].graded) == (5, "", False)
    assert (after["300"].blueprint_id, after["300"].graded, after["900"].quantity) == (13, True, 9)
    summary = rc.reconcile_summary(outcomes).first()
    assert (summary.updated, summary.created, summary.errors, summary.total_processed) == (1, 1, 4, 2)


def test_status_machine(spark):
    events = [("u", 1, "setup", None, "s"), ("u", 2, "start", None, None), ("u", 3, "success", None, None),
              ("u", 4, "start", None, None), ("u", 5, "failure", "boom", None), ("v", 1, "setup", None, "t"),
              ("v", 2, "remove", None, None), ("w", 1, "failure", "x", None), ("w", 2, "success", None, None)]
    frame = spark.createDataFrame(events, "user_id string, seq long, event string, error string, webhook_secret string")
    got = {r.user_id: r for r in op.sync_status(frame.withColumn("ts", F.timestamp_seconds("seq"))).collect()}
    assert (got["u"].sync_status, got["u"].last_error, got["u"].has_token) == ("error", "boom", True)
    assert got["u"].last_sync_at.timestamp() == 3 and got["u"].webhook_secret == "s"
    assert (got["v"].sync_status, got["v"].has_token, got["v"].webhook_secret) == ("idle", False, None)
    assert (got["w"].sync_status, got["w"].last_error) == ("active", None)


def test_iso_text(spark):
    times = spark.sql("select timestamp'2024-01-02 03:04:05.000600' a, timestamp'2024-01-02 03:04:05' b")
    row = times.select(op.iso_text(F.col("a")).alias("a"), op.iso_text(F.col("b")).alias("b")).first()
    assert tuple(row) == ("2024-01-02T03:04:05.000600+00:00", "2024-01-02T03:04:05+00:00")


def test_snapshots_and_schema(spark, tmp_path):
    path = str(tmp_path / "inventory")
    old = spark.createDataFrame([(1, "u", 5)], "id long, user_id string, quantity int")
    wr.write_inventory(wr.evolve_schema(old, schemas.INVENTORY), path, 1)
    wr.write_inventory(wr.evolve_schema(old.withColumn("quantity", F.lit(9)), schemas.INVENTORY), path, 2)
    wr.write_inventory(wr.evolve_schema(old.withColumn("quantity", F.lit(9)), schemas.INVENTORY), path, 2)
    assert wr.current_version(spark, path) == 2
    assert [r.quantity for r in wr.read_snapshot(spark, path, schemas.INVENTORY).collect()] == [9]
    assert [r.quantity for r in wr.read_snapshot(spark, path, schemas.INVENTORY, 1).collect()] == [5]
    assert wr.read_snapshot(spark, path, schemas.INVENTORY).first().graded is None
    operations = spark.createDataFrame([("o", {"processed": 3})], "operation_id string, metadata struct<processed: long>")
    moved = wr.evolve_schema(operations, "operation_id string, operation_metadata struct<processed: long>, status string")
    assert moved.first().operation_metadata.processed == 3


def _event(number, cause, state, items):
    body = {"id": f"e{number}", "cause": cause, "mode": "live",
            "data": {"id": number, "state": state, "seller": {"id": USER}, "order_items": items}}
    return json.dumps({"received_at": f"2024-01-01T00:{number // 60:02d}:{number % 60:02d}Z", "user_id": None,
                       "signature": "", "body": json.dumps(body)})


def test_stream_over_many_triggers_equals_one_by_one(spark, tmp_path):
    rng = random.Random(9)
    stock = {str(i): rng.randint(0, 9) for i in range(12)}
    inventory = spark.createDataFrame([(int(k), USER, k, q) for k, q in stock.items()],
                                      "id long, user_id string, external_stock_id string, quantity int")
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    expected, number = {}, 0
    for trigger in range(4):
        lines = []
        for _ in range(40):
            number += 1
            sells = rng.random() < 0.6
            items = [{"product_id": str(0 if rng.random() < 0.3 else rng.randint(0, 13)), "quantity": rng.randint(0, 5)}
                     for _ in range(rng.randint(1, 3))]
            lines.append(_event(number, "order.create" if sells else "order.destroy", "paid", items))
            for ln, item in enumerate(items):
                key, n = item["product_id"], item["quantity"]
                if key == "0" or n <= 0:
                    continue
                if key in stock:
                    stock[key] = max(0, stock[key] + (-n if sells else n))
                expected[(f"e{number}", ln)] = stock.get(key)
            if rng.random() < 0.2:
                lines.append(lines[-1])
        (feed / f"part-{trigger}.json").write_text("\n".join(lines))
        events = st.dedupe_stream(rd.read_order_events(spark, str(feed)))
        st.stream_stock_ledger(event_deltas(events), inventory, out, str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.event_id, r.ln): r.new_quantity for r in spark.read.parquet(f"{out}/ledger").collect()}
    assert got == expected
    assert spark.read.parquet(f"{out}/ledger").select("batch").distinct().count() >= 4
    settled = {r.external_stock_id: r.quantity for r in st.settled_inventory(inventory, out).collect()}
    assert settled == stock


def test_stream_bucket_keeps_state_between_triggers(spark, tmp_path):
    folder, out = tmp_path / "requests", str(tmp_path / "audit")
    schema = "user_id string, request_id long, ts timestamp"
    for start in (0, 4):
        rows = spark.createDataFrame([("u", start + i, start + i) for i in range(4)], "user_id string, request_id long, t long")
        rows.select("user_id", "request_id", F.timestamp_seconds("t").alias("ts")).write.mode("append").parquet(str(folder))
        stream = sv.stream_throttle_audit(spark.readStream.schema(schema).parquet(str(folder)), 3, 6)
        sinks.run_available(stream, out, str(tmp_path / "audit-checkpoint"))
    got = {r.request_id: (r.allowed, r.wait_seconds) for r in spark.read.parquet(out).collect()}
    assert got == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, 3.0), 4: (False, 2.0), 5: (False, 1.0),
                   6: (True, None), 7: (True, None)}


def test_stream_goes_on_after_a_snapshot(spark, tmp_path):
    inventory_path, feed = str(tmp_path / "inventory"), tmp_path / "feed"
    feed.mkdir()
    start = spark.createDataFrame([(1, USER, 7, 5, 100, None, "7", None, None, None, None, None)], schemas.INVENTORY)
    wr.write_inventory(start, inventory_path, 1)
    for number, cause, sold in ((1, "order.create", 8), (2, "order.destroy", 3), (3, "order.create", 1)):
        (feed / f"{number}.json").write_text(_event(number, cause, "paid", [{"product_id": "7", "quantity": sold}]))
        current = wr.read_snapshot(spark, inventory_path, schemas.INVENTORY)
        events = rd.read_order_events(spark, str(feed))
        ledger = str(tmp_path / f"ledger-{number}")
        st.stream_stock_ledger(event_deltas(events), current, ledger, str(tmp_path / "checkpoint")).awaitTermination()
        assert jobs.run_settle(spark, inventory_path, ledger) == number + 1
    assert wr.read_snapshot(spark, inventory_path, schemas.INVENTORY).first().quantity == 2


def test_event_answers(spark, tmp_path):
    lines = [_event(1, "order.create", "paid", [{"product_id": "7", "quantity": 1}, {"product_id": "9", "quantity": 1}]),
             _event(2, "order.create", "pending", []), _event(3, "order.destroy", "x", []), _event(4, "ping", "x", []),
             _event(5, "order.destroy", "x", []).replace(USER, "123")]
    (tmp_path / "feed.json").write_text("\n".join(lines))
    events = rd.read_order_events(spark, str(tmp_path / "feed.json"), stream=False)
    inventory = spark.createDataFrame([(1, USER, "7", 5)], "id long, user_id string, external_stock_id string, quantity int")
    results = ev.event_results(stock_ledger(event_deltas(events), inventory, ev.LINE_ORDER))
    got = {r.order_id: r for r in event_answers(events, results).collect()}
    assert [got[i].status for i in range(1, 6)] == ["processed", "ignored", "processed", "ignored", "error"]
    assert (got[1].items_processed, got[1].items[0].new_quantity) == (1, 4)
    assert got[1].errors[0].error == "Product not found in local inventory" and got[1].action is None
    assert (got[3].items_processed, got[3].action) == (0, "restore_quantities")
    assert got[4].message == "Unsupported webhook cause" and got[5].message == "Invalid user_id format: 123"
