"""Seller buckets: what a job leaves alone, jobs side by side, and jobs that must be run again."""

import pytest
from pyspark.sql import functions as F

from stockline import schemas
from stockline.plans import jobs
from stockline.sources import files, snapshots

SELLERS = [f"seller-{k}" for k in range(40)]
PATCH = ("item_id long, user_id string, quantity int, price_cents int, description string, user_data_field string, "
         "graded boolean, properties string, seq int")


@pytest.fixture
def path(spark, tmp_path):
    rows = [(100 * k + n, user, n, 5, 100, None, str(100 * k + n), None, None, None, None, None)
            for k, user in enumerate(SELLERS) for n in range(1, 4)]
    inventory = spark.createDataFrame(rows, schemas.INVENTORY)
    snapshots.write_inventory(inventory, str(tmp_path / "inventory"), 1, buckets=64)
    return str(tmp_path / "inventory")


def patch(spark, user, quantity):
    number = 100 * SELLERS.index(user) + 1
    return spark.createDataFrame([(number, user, quantity, None, None, None, None, None, 1)], PATCH)


def stored_files(spark, path, record):
    return {b: snapshots.read_buckets(spark, path, record, schemas.INVENTORY, [b]).inputFiles() for b in record.folders}


def quantities(spark, path):
    return {r.id: r.quantity for r in snapshots.read_snapshot(spark, path, schemas.INVENTORY).collect()}


def other_bucket(record, spark, user):
    """A seller whose bucket is another one."""
    of = {r.user_id: r.b for r in spark.createDataFrame([(s,) for s in SELLERS], "user_id string")
          .withColumn("b", record.bucket()).collect()}
    return next(s for s in SELLERS if of[s] != of[user])


def test_an_edit_leaves_all_other_buckets_files(spark, path, tmp_path):
    before = snapshots.snapshot(spark, path)
    then = stored_files(spark, path, before)
    jobs.run_edits(spark, patch(spark, "seller-3", 77), path, str(tmp_path / "outbox"))
    after = snapshots.snapshot(spark, path)
    (mine,) = snapshots.touched_buckets(before, patch(spark, "seller-3", 77))
    now = stored_files(spark, path, after)
    assert {b for b in now if now[b] != then[b]} == {mine}
    assert files.names(spark, f"{path}/{after.folders[mine]}") == ["_SUCCESS", f"_bucket={mine}"]
    got = quantities(spark, path)
    assert got.pop(301) == 77 and set(got.values()) == {5} and len(got) == 119


def test_jobs_on_other_sellers_both_succeed(spark, path, tmp_path):
    base = snapshots.snapshot(spark, path)
    other = other_bucket(base, spark, "seller-0")
    works = [jobs._Work.on(path, patch(spark, user, 9)) for user in ("seller-0", other)]
    for user, work in zip(("seller-0", other), works, strict=True):  # both have read version 1
        work.store(work.inventory.withColumn("quantity", F.when(F.col("user_id") == user, 9).otherwise(F.col("quantity"))))
    assert snapshots.current_version(spark, path) == 3
    got = quantities(spark, path)
    assert sorted(i for i, n in got.items() if n == 9) == sorted(
        100 * SELLERS.index(u) + n for u in ("seller-0", other) for n in (1, 2, 3))


def test_the_second_of_two_jobs_on_a_seller_is_run_again(spark, path, tmp_path, monkeypatch):
    work = jobs._Work.on(path, patch(spark, "seller-5", 1))
    jobs.run_edits(spark, patch(spark, "seller-5", 8), path, str(tmp_path / "outbox"))
    with pytest.raises(snapshots.VersionTaken):
        work.store(work.inventory)
    assert quantities(spark, path)[501] == 8

    monkeypatch.setattr(jobs, "PAUSE_SECONDS", 0.01)
    runs = []

    @jobs.repeated
    def job(fail):
        runs.append(1)
        work = jobs._Work.on(path, patch(spark, "seller-5", 1))
        if len(runs) <= fail:
            jobs.run_edits(spark, patch(spark, "seller-5", 20 + len(runs)), path, str(tmp_path / "outbox"))
        return work.store(work.inventory.withColumn("quantity", F.col("quantity") + 100)).version

    job(2)
    assert len(runs) == 3 and quantities(spark, path)[501] == 122
    with pytest.raises(snapshots.VersionTaken):
        job(99)
    assert len(runs) == 3 + jobs.ATTEMPTS


def test_an_unfinished_version_is_passed_over(spark, path, tmp_path):
    assert files.create(spark, f"{path}/versions/2.json", "")
    assert snapshots.current_version(spark, path) == 1
    jobs.run_edits(spark, patch(spark, "seller-1", 6), path, str(tmp_path / "outbox"))
    assert snapshots.current_version(spark, path) == 3 and quantities(spark, path)[101] == 6


def test_a_seller_may_lose_all_items_and_get_some_again(spark, path, tmp_path):
    wanted = spark.createDataFrame([("seller-2", 200 + n) for n in (1, 2, 3)], "user_id string, item_id long")
    jobs.run_deletes(spark, wanted, path, str(tmp_path / "outbox"))
    assert not any(200 < i < 300 for i in quantities(spark, path))
    work = jobs._Work.on(path, wanted)
    first = snapshots.take_ids(spark, path, 2)
    assert first == 3904
    rows = spark.createDataFrame([(first + n, "seller-2", 1, 4, 1, None, None, None, None, None, None, None) for n in range(2)],
                                 schemas.INVENTORY)
    work.store(work.inventory.unionByName(rows))
    assert {i for i in quantities(spark, path) if i > 3903} == {3904, 3905}
    with pytest.raises(ValueError):
        snapshots.replace_buckets(rows, path, snapshots.snapshot(spark, path), [])


def test_import_shows_its_progress_and_does_not_blame_sellers_for_a_race(spark, path, tmp_path, monkeypatch):
    for name in schemas.CATALOG_TABLES:
        spark.createDataFrame([(1, 1)] if name == "cards_prints" else [], schemas.CATALOG).write.parquet(str(tmp_path / "catalog" / name))
    folder = tmp_path / "export" / "user_id=seller-1"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('[{"id": 101, "blueprint_id": 1, "quantity": 50}, {"id": 999, "blueprint_id": 1}]')
    settings = spark.createDataFrame([("seller-1", True, None, "idle", None, None, None, None)], schemas.SETTINGS)
    log = spark.createDataFrame([], schemas.OPERATIONS)
    requests = spark.createDataFrame([("seller-1", "op", False)], "user_id string, operation_id string, force boolean")
    shown = []

    def on_start(moved, operations):
        shown.append((moved.first().sync_status, operations.first().status, quantities(spark, path)[101]))

    args = requests, settings, log, str(tmp_path / "export"), str(tmp_path / "catalog"), path
    done = jobs.run_requested_import(spark, *args, on_start=on_start)
    assert shown == [("initial_sync", "pending", 5)]
    got = quantities(spark, path)
    assert (got[101], got[3904], len(got)) == (50, 0, 121)
    row = done.settings.first()
    assert row.sync_status == "active" and row.updated_at == done.settings.first().updated_at
    operation = done.operations.first()
    assert operation.created_at == done.operations.first().created_at and operation.operation_metadata.created == 1

    def lost(*_):
        raise snapshots.VersionTaken("x")

    monkeypatch.setattr(jobs, "PAUSE_SECONDS", 0.001)
    monkeypatch.setattr(snapshots, "replace_buckets", lost)
    with pytest.raises(snapshots.VersionTaken):
        jobs.run_requested_import(spark, *args)
