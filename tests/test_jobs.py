import json

import pytest
from pyspark.sql import functions as F

from stockline import schemas
from stockline.plans import jobs
from stockline.sources import readers, writers


@pytest.fixture
def store(spark, tmp_path):
    inventory = spark.createDataFrame(
        [(1, "u", 10, 5, 100, '{"condition":"NM"}', "100", None, None, None, None, None),
         (2, "v", 11, 2, 50, None, None, None, None, None, None, None)], schemas.INVENTORY)
    writers.write_inventory(inventory, str(tmp_path / "inventory"), 1)
    for name, rows in {"cards_prints": [(1, 10)], "op_prints": [(2, 12)], "pk_prints": [(3, 13)], "sealed_products": []}.items():
        spark.createDataFrame(rows, schemas.CATALOG).write.parquet(str(tmp_path / "catalog" / name))
    for user, products in {
        "u": [{"id": 100, "blueprint_id": 10, "quantity": 7, "price_cents": 120, "properties_hash": {"signed": True}},
              {"id": 101, "blueprint_id": 13, "quantity": 1, "price_cents": 9}, {"id": 102, "blueprint_id": 12}],
        "v": [{"id": 200, "blueprint_id": 99, "quantity": 1}, {"id": 201, "blueprint_id": 13, "quantity": 4}],
    }.items():
        folder = tmp_path / "export" / f"user_id={user}"
        folder.mkdir(parents=True)
        (folder / "export.json").write_text(json.dumps(products))
    return tmp_path


def _items(spark, store):
    rows = writers.read_snapshot(spark, str(store / "inventory"), schemas.INVENTORY).collect()
    return {(r.user_id, r.external_stock_id): r for r in rows}


def test_import_then_edit_purchase_and_delete(spark, store):
    inventory, outbox = str(store / "inventory"), str(store / "outbox")
    summary, progress = jobs.run_import(spark, str(store / "export"), str(store / "catalog"), inventory)
    assert {r.user_id: (r.processed, r.created, r.updated, r.skipped) for r in summary.collect()} == {
        "u": (3, 1, 1, 1), "v": (2, 1, 0, 1)}
    assert {r.progress_percent for r in progress.collect()} == {100}
    items = _items(spark, store)
    assert items[("u", "100")].quantity == 7 and json.loads(items[("u", "100")].properties) == {"signed": True}
    assert sorted(r.id for r in items.values()) == [1, 2, 3, 4]

    operations = spark.createDataFrame(
        [(1, "u", "op1", "bulk_sync", "pending", None, None, None), (2, "x", "op2", "bulk_sync", "pending", None, None, None)],
        schemas.OPERATIONS)
    done = {r.operation_id: r for r in jobs.finish_operations(operations, summary, F.current_timestamp()).collect()}
    assert (done["op1"].status, done["op1"].operation_metadata.created, done["op2"].status) == ("completed", 1, "pending")

    patches = spark.createDataFrame(
        [(1, "u", 9, None, None, None, None, None, 1), (1, "u", None, 130, None, None, None, '{"signed":"no"}', 2),
         (1, "u", -1, None, None, None, None, None, 3), (2, "v", 3, None, None, None, None, None, 4)],
        "item_id long, user_id string, quantity int, price_cents int, description string, user_data_field string, "
        "graded boolean, properties string, seq long")
    refused = jobs.run_edits(spark, patches, inventory, outbox)
    assert [r.seq for r in refused.collect()] == [3]
    item = _items(spark, store)[("u", "100")]
    assert (item.quantity, item.price_cents, json.loads(item.properties)) == (9, 130, {"signed": "no"})
    (sent,) = spark.read.json(f"{outbox}/update=3").collect()
    assert json.loads(sent.body) == {"id": 100, "price": 1.3, "quantity": 9, "properties": {"signed": False}}

    requests = spark.createDataFrame([("r1", 1, "u", 7, 1), ("r2", 1, "u", 1, 2)],
                                     "request_id string, item_id long, user_id string, quantity int, t long")
    export = readers.read_export(spark, str(store / "export"))
    decided = jobs.run_purchases(spark, requests.withColumn("ts", F.timestamp_seconds("t")), export, inventory, outbox)
    assert {r.request_id: r.status for r in decided.collect()} == {"r1": "success", "r2": "error"}
    (remote,) = spark.read.json(f"{outbox}/purchase=4").collect()
    assert (remote.action, remote.product_id) == ("delete", 100)
    assert _items(spark, store)[("u", "100")].quantity == 0

    wanted = spark.createDataFrame([("u", 1), ("u", 2)], "user_id string, item_id long")
    missing = jobs.run_deletes(spark, wanted, inventory, outbox)
    assert [(r.id, r.error) for r in missing.collect()] == [(2, "Inventory item not found")]
    assert ("u", "100") not in _items(spark, store)
    assert [r.product_id for r in spark.read.json(f"{outbox}/delete=5").collect()] == [100]


def test_reconcile_job(spark, store):
    summary, errors = jobs.run_reconcile(spark, str(store / "export"), str(store / "catalog"), str(store / "inventory"))
    assert {r.user_id: (r.updated, r.created, r.errors) for r in summary.collect()} == {"u": (1, 2, 0), "v": (0, 1, 1)}
    assert [r.error for r in errors.collect()] == ["Blueprint 99 not found in mapping"]
    items = _items(spark, store)
    assert (items[("u", "102")].quantity, items[("u", "102")].description, items[("u", "100")].graded) == (0, "", False)
