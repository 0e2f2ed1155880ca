"""Rows that used to be dropped, capped or to stop a job."""

import pytest

from stockline.operators import events, ledger, listings, operations, products, telemetry


def test_events_without_an_id_all_stay(spark):
    rows = [("a", 1), ("a", 2), ("unknown", 3), ("unknown", 4), (None, 5)]
    kept = events.dedupe_events(spark.createDataFrame(rows, "id string, ts int")).collect()
    assert sorted(r.ts for r in kept) == [1, 3, 4, 5]


def test_changes_without_a_time_come_first_in_ledger_and_inventory(spark):
    inventory = spark.createDataFrame([(1, "u", "s", 10)], "id long, user_id string, external_stock_id string, quantity int")
    deltas = spark.createDataFrame([("u", "s", -3, None, 1), ("u", "s", -2, "2024-01-01 00:00:00", 2)],
                                   "user_id string, external_stock_id string, delta int, ts string, n int")
    deltas = deltas.withColumn("ts", deltas["ts"].cast("timestamp"))
    rows = {r.n: (r.old_quantity, r.new_quantity) for r in ledger.stock_ledger(deltas, inventory, ["ts", "n"]).collect()}
    assert rows == {1: (10, 7), 2: (7, 5)}
    assert ledger.apply_deltas(inventory, deltas, ["ts", "n"]).first().quantity == 5


def test_rows_without_a_seller_are_chunked(spark):
    export = spark.createDataFrame([("u", 1), (None, 2), (None, 3)], "user_id string, seq long")
    found = products.chunk_index(export, 1).collect()
    assert sorted((r.seq, r.chunk, r.total_chunks) for r in found) == [(1, 0, 1), (2, 0, 2), (3, 1, 2)]


def test_limits_are_honoured(spark):
    items = spark.range(1500).selectExpr("id", "'u' as user_id", "7L as blueprint_id", "1 as quantity", "5 as price_cents",
                                         "current_timestamp() as updated_at")
    assert listings.listings_for(items, 7, 1200).count() == listings.top_listings(items, 1200).count() == 1200
    assert listings.inventory_page(items, "u", 1400, 50).count() == 1400
    with pytest.raises(ValueError):
        listings.listings_for(items, 7, 0)


def test_histogram_takes_all_values(spark):
    values = spark.range(3000).selectExpr("'m' as name", "'x' as label", "id as seq", "cast(id as double) as value",
                                          "current_timestamp() as ts")
    assert telemetry.histogram_stats(values, ["label"]).first()["count"] == 3000


def test_two_requests_of_a_seller_start_one_import(spark):
    settings = spark.createDataFrame([("u", True, "idle"), ("v", True, "active")], "user_id string, has_token boolean, sync_status string")
    requests = spark.createDataFrame([("u", "b", False), ("u", "a", True), ("v", "c", False), ("v", "d", True), ("w", "e", True)],
                                     "user_id string, operation_id string, force boolean")
    got = {r.operation_id: (r.allowed, r.reason) for r in operations.start_guard(requests, settings).collect()}
    busy = "sync in progress: initial_sync"
    assert got == {"a": (True, None), "b": (False, busy), "c": (False, "sync in progress: active"), "d": (True, None),
                   "e": (False, "settings not found")}
