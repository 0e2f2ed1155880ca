"""Stored versions, ids, file order, the import's life and rows that must not stop a job."""

import json

import pytest
from pyspark.sql import functions as F

from stockline import schemas
from stockline.functions.signature import signing_pads
from stockline.operators import edits, ledger, purchases
from stockline.operators.products import chunk_index, last_write
from stockline.plans import jobs
from stockline.plans.order_flow import accept_events
from stockline.sources import readers, snapshots, writers
from stockline.streaming import sinks, stock

USER = "db24fb13-ec73-49b8-932c-f0043dd47e86"
PATCH = ("item_id long, user_id string, quantity int, price_cents int, description string, user_data_field string, "
         "graded boolean, properties string")


def _inventory(spark, *rows):
    return spark.createDataFrame([(i, u, 10, n, 100, text, stock_id, None, None, None, None, None)
                                  for i, u, n, text, stock_id in rows], schemas.INVENTORY)


def test_a_version_has_one_owner(spark, tmp_path):
    path = str(tmp_path / "inventory")
    writers.write_inventory(_inventory(spark, (1, "u", 5, None, "1")), path, 1)
    writers.write_inventory(_inventory(spark, (1, "u", 6, None, "1")), path, 2, "a")
    with pytest.raises(writers.VersionTaken):
        writers.write_inventory(_inventory(spark, (1, "u", 7, None, "1")), path, 2, "b")
    writers.write_inventory(_inventory(spark, (1, "u", 8, None, "1")), path, 2, "a")
    assert writers.read_snapshot(spark, path, schemas.INVENTORY).first().quantity == 8


def test_ids_are_not_given_again(spark, tmp_path):
    path = str(tmp_path / "inventory")
    writers.write_inventory(_inventory(spark, (1, "u", 5, None, "1"), (2, "u", 5, None, "2")), path, 1)
    wanted = spark.createDataFrame([("u", 2)], "user_id string, item_id long")
    jobs.run_deletes(spark, wanted, path, str(tmp_path / "outbox"))
    base = snapshots.snapshot(spark, path)
    first = snapshots.take_ids(spark, path, 1)
    rows = writers.read_snapshot(spark, path, schemas.INVENTORY).unionByName(_inventory(spark, (first, "u", 1, None, "3")))
    snapshots.replace_buckets(rows, path, base, list(base.folders))
    rows = writers.read_snapshot(spark, path, schemas.INVENTORY).collect()
    assert {r.external_stock_id: r.id for r in rows} == {"1": 1, "3": 3}
    assert [snapshots.take_ids(spark, path, n) for n in (5, 1)] == [4, 9]


def test_export_rows_follow_files_by_name(spark, tmp_path):
    folder = tmp_path / "user_id=u"
    folder.mkdir()
    (folder / "part-1.json").write_text("\n".join(json.dumps({"id": n, "quantity": 1}) for n in (7, 8)))
    (folder / "part-2.json").write_text("\n".join(json.dumps({"id": n, "quantity": 2}) for n in (7, *range(100, 400))))
    read = readers.read_export(spark, str(tmp_path), multiline=False)
    assert {r.id: r.quantity for r in last_write(read, ["user_id", "id"]).where("id < 9").collect()} == {7: 2, 8: 1}
    placed = {(r.id, r.quantity): r.position for r in chunk_index(read, 100).collect()}
    assert (placed[(7, 1)], placed[(8, 1)], placed[(7, 2)], placed[(399, 2)]) == (1, 2, 3, 303)


def test_requested_import(spark, tmp_path):
    inventory = str(tmp_path / "inventory")
    writers.write_inventory(_inventory(spark, (1, "u", 5, None, "100")), inventory, 1)
    for name, rows in {"cards_prints": [(1, 10)], "op_prints": [], "pk_prints": [], "sealed_products": []}.items():
        spark.createDataFrame(rows, schemas.CATALOG).write.parquet(str(tmp_path / "catalog" / name))
    for user in ("u", "busy", "bare"):
        folder = tmp_path / "export" / f"user_id={user}"
        folder.mkdir(parents=True)
        (folder / "a.json").write_text(json.dumps([{"id": 100, "blueprint_id": 10, "quantity": 9}]))
    settings = spark.createDataFrame(
        [("u", True, None, "idle", None, "old", None, None), ("busy", True, None, "active", None, None, None, None),
         ("bare", False, None, "idle", None, None, None, None), ("empty", True, None, "error", None, "old", None, None)],
        schemas.SETTINGS)
    requests = spark.createDataFrame([(u, f"op-{u}", False) for u in ("u", "busy", "bare", "empty", "nobody")],
                                     "user_id string, operation_id string, force boolean")
    log = spark.createDataFrame([(1, "u", "earlier", "bulk_sync", "pending", None, None, None)], schemas.OPERATIONS)
    paths = str(tmp_path / "export"), str(tmp_path / "catalog"), inventory
    done = jobs.run_requested_import(spark, requests, settings, log, *paths)
    assert {r.user_id: r.reason for r in done.answers.collect()} == {
        "u": None, "empty": None, "busy": "sync in progress: active", "bare": "no token", "nobody": "settings not found"}
    operations = {r.operation_id: r for r in done.operations.collect()}
    assert {k: r.status for k, r in operations.items()} == {"earlier": "pending", "op-u": "completed", "op-empty": "completed"}
    assert (operations["op-u"].operation_metadata.updated, operations["op-empty"].operation_metadata.processed) == (1, 0)
    after = {r.user_id: (r.sync_status, r.last_error, r.last_sync_at is None) for r in done.settings.collect()}
    assert after == {"u": ("active", None, False), "empty": ("active", None, False), "busy": ("active", None, True),
                     "bare": ("idle", None, True)}
    rows = writers.read_snapshot(spark, inventory, schemas.INVENTORY).collect()
    assert [(r.user_id, r.quantity) for r in rows] == [("u", 9)]

    failed = jobs.run_requested_import(spark, requests, settings, log, str(tmp_path / "none"), *paths[1:])
    states = {r.user_id: r.sync_status for r in failed.settings.collect()}
    assert failed.failure and (states["u"], states["busy"]) == ("error", "active")
    assert {r.operation_id: r.status for r in failed.operations.collect()}["op-u"] == "pending"


def test_sellers_without_settings_or_token_sell_nothing(spark):
    items = _inventory(spark, (1, "on", 5, None, "11"), (2, "off", 5, None, "12"), (3, "gone", 5, None, "13"))
    export = spark.createDataFrame([(u, n, 5, 1) for u, n in (("on", 11), ("off", 12), ("gone", 13))],
                                   "user_id string, id long, quantity int, seq long")
    settings = spark.createDataFrame([("on", True), ("off", False)], "user_id string, has_token boolean")
    requests = spark.createDataFrame([("a", 1, "on", 2), ("b", 2, "off", 2), ("c", 3, "gone", 2), ("d", 2, "off", 9)],
                                     "request_id string, item_id long, user_id string, quantity int")
    requests = requests.withColumn("ts", F.timestamp_seconds(F.lit(1)))
    decided = purchases.decide_purchases(requests, items, export, settings)
    got = {r.request_id: (r.status, r.quantity_after, r.error) for r in decided.collect()}
    assert got == {"a": ("success", 3, None), "b": ("refused", 5, "no token"),
                   "c": ("refused", 5, "User not found in sync settings"),
                   "d": ("error", 5, "Insufficient quantity. Available: 5, Requested: 9")}
    settled = {r.id: (r.quantity, r.updated_at is None)
               for r in purchases.settle_purchases(items, decided, F.current_timestamp()).collect()}
    assert settled == {1: (3, False), 2: (5, True), 3: (5, True)}


def test_last_row_of_a_remote_product_counts(spark):
    export = spark.createDataFrame([("u", 1, 9, 1), ("u", 1, 3, 2), ("u", 2, None, 3)],
                                   "user_id string, id long, quantity int, seq long")
    got = {r.external_stock_id: r.remote_quantity for r in purchases.remote_stock(export).collect()}
    assert got == {"1": 3, "2": 0}


def test_two_patches_of_an_item_stop_the_job(spark):
    items = _inventory(spark, (1, "u", 5, None, "1"))
    twice = spark.createDataFrame([(1, "u", n, None, None, None, None, None) for n in (6, 7)], PATCH)
    with pytest.raises(Exception, match="several patches of item 1"):
        edits.apply_patches(items, twice, F.current_timestamp()).collect()


def test_broken_and_repeated_properties(spark):
    items = _inventory(spark, (1, "u", 5, "{broken", "1"), (2, "u", 5, '{"a":1,"a":2}', "2"))
    given = spark.createDataFrame([(i, "u", 6, None, None, None, None, '{"b":1,"b":3}') for i in (1, 2)], PATCH)
    after = {r.id: (r.quantity, r.properties) for r in edits.apply_patches(items, given, F.current_timestamp()).collect()}
    assert after == {1: (6, "{broken"), 2: (6, '{"a":2,"b":3}')}
    assert [r.item_id for r in edits.broken_properties(items, given).collect()] == [1]
    assert {r.id: r.properties_changed for r in edits.detect_changes(items, given).collect()} == {1: True, 2: True}


def test_a_quantity_out_of_range_stays_and_is_reported(spark):
    items = _inventory(spark, (1, "u", 2147483000, None, "1"), (2, "u", 1, None, "2"))
    moves = spark.createDataFrame([("u", "1", 2000000, 1), ("u", "2", 4, 1)],
                                  "user_id string, external_stock_id string, delta int, n int")
    moves = moves.withColumn("ts", F.timestamp_seconds("n"))
    assert {r.id: r.quantity for r in ledger.apply_deltas(items, moves, ["ts"]).collect()} == {1: 2147483000, 2: 5}
    (row,) = ledger.overflowing(items, ledger.fold_deltas(moves, ["ts"])).collect()
    assert (row.item_id, row.quantity_wanted) == (1, 2149483000)


def _line(number, received, user_id=None, seller=USER):
    body = {"id": f"e{number}", "cause": "order.create", "mode": "live", "data": {
        "id": number, "state": "paid", "seller": {"id": seller}, "order_items": [{"product_id": "7", "quantity": 1}]}}
    return json.dumps({"received_at": received, "user_id": user_id, "signature": "", "body": json.dumps(body)})


def test_late_events_reach_the_stream(spark, tmp_path):
    feed, out = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    for number, received in ((1, "2024-01-01T12:00:00Z"), (2, "2024-01-01T13:00:00Z"), (3, "2024-01-01T10:00:00Z")):
        copies = [_line(number, received)] + ([_line(1, "2024-01-01T12:00:00Z")] if number > 1 else [])
        (feed / f"{number}.json").write_text("\n".join(copies))
        events = stock.dedupe_stream(readers.read_order_events(spark, str(feed)))
        sinks.run_available(events.select("id", "ts"), out, str(tmp_path / "checkpoint"))
    assert sorted(r.id for r in spark.read.schema("id string").parquet(out).collect()) == ["e1", "e2", "e3"]


def test_unknown_sellers_are_rejected_in_batch_and_stream(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    stranger = "00000000-0000-0000-0000-000000000001"
    lines = [_line(1, "2024-01-01T12:00:00Z"), _line(2, "2024-01-01T12:00:00Z", USER),
             _line(3, "2024-01-01T12:00:00Z", stranger), _line(4, "2024-01-01T12:00:00Z", "nonsense")]
    (feed / "a.json").write_text("\n".join(lines))
    pads = signing_pads(spark.createDataFrame([(USER, "secret")], "user_id string, webhook_secret string"))
    good, bad = accept_events(readers.read_order_events(spark, str(feed), stream=False), pads)
    assert {r.id: r.signature_status for r in good.collect()} == {"e1": None, "e2": "unsigned"}
    assert {r.id: r.message for r in bad.collect()} == {
        "e3": "User not found in sync settings", "e4": "Invalid user_id format: nonsense"}
    inventory = _inventory(spark, (1, USER, 5, None, "7"))
    deltas = stock.stream_deltas(readers.read_order_events(spark, str(feed)), pads)
    stock.stream_stock_ledger(deltas, inventory, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert stock.settled_inventory(inventory, str(tmp_path / "out")).first().quantity == 3
