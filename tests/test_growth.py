"""What tasks read, write and hold grows in number with the input, not in size."""

import glob

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from stockline import schemas
from stockline.functions.quality import canonical_uuid
from stockline.plans import jobs, order_flow
from stockline.registry import flows
from stockline.session import configure
from stockline.sources import snapshots
from stockline.streaming import stock as st
from stockline.streaming.fold_log import MOST_BUCKETS, FoldLog

SF_DIR = "/root/testdata/sf0.001"
USER = "db24fb13-ec73-49b8-932c-f0043dd47e86"


class Stop(Exception):
    pass


def stop(*_, **__):
    raise Stop


def test_feeds_are_written_compressed(spark):
    for retries in (False, True):
        found = glob.glob(f"{flows._event_files(spark, SF_DIR, retries)}/part-*")
        assert found and all(name.endswith(".json.gz") for name in found)


def test_parts_of_a_stream_are_written_by_all_tasks(spark):
    rows = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") != 7, F.col("id")).alias("n"))
    parts = flows._dealt(rows, F.pmod("n", F.lit(3)), "parts")
    assert [p.count() for p in parts] == [334, 332, 333]  # a row without a number is in no part
    assert all(len(p.inputFiles()) >= 4 for p in parts)
    assert sorted(r.id for p in parts for r in p.collect()) == [i for i in range(1000) if i != 7]


def test_buckets_of_a_ledger_are_bounded(spark, tmp_path):
    items = spark.range(2 * MOST_BUCKETS).select("id", F.lit("u").alias("user_id"), F.lit(5).alias("quantity"),
                                                 F.col("id").cast("string").alias("external_stock_id"))
    log = FoldLog.begin(items, str(tmp_path / "log"), bucket_items=1)
    assert log.buckets == MOST_BUCKETS and log.stock(spark).count() == 2 * MOST_BUCKETS


def test_a_trigger_works_in_the_session_of_the_inventory(spark, tmp_path, monkeypatch):
    session, found = flows.stream_session(spark, 2), []
    inventory = spark.createDataFrame([(1, USER, "7", 5)], "id long, user_id string, external_stock_id string, quantity int")
    deltas = spark.createDataFrame([(USER, "7", -2, 1, "e", 0, 2)], "user_id string, external_stock_id string, delta long, "
                                   "t long, event_id string, ln int, quantity int")
    deltas.withColumn("ts", F.timestamp_seconds("t")).write.parquet(str(tmp_path / "deltas"))
    real = st.ledger_from
    monkeypatch.setattr(st, "ledger_from", lambda rows, *rest: found.append(rows.sparkSession) or real(rows, *rest))
    schema = spark.read.parquet(str(tmp_path / "deltas")).schema
    stream = session.readStream.schema(schema).parquet(str(tmp_path / "deltas"))
    st.stream_stock_ledger(stream, inventory, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [s.conf.get("spark.sql.adaptive.enabled") for s in found] == ["true"]
    assert spark.read.parquet(f"{tmp_path}/out/ledger").first().new_quantity == 3


def test_export_files_grow_in_number(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(flows, "FILE_ROWS", 300, raising=False)
    monkeypatch.setattr(flows, "_store", lambda frame, *_: seen.append(frame.rdd.getNumPartitions()) or stop())
    with pytest.raises(Stop):
        flows.read_export_all(spark, SF_DIR)
    assert seen[0] > 8


@pytest.mark.parametrize("name", ["read_export_all", "import_job", "import_lifecycle"])
def test_sellers_share_export_files(spark, monkeypatch, name):
    """Twenty times the sellers: not a folder and not a file more, and each row keeps its seller."""
    files, exports = [], []

    def rows(sellers):
        return spark.range(200).select(
            F.when(F.col("id") > 3, F.col("id") % sellers).alias("user_id"), F.col("id"), F.lit(5).alias("blueprint_id"),
            F.lit(2).alias("quantity"), F.lit(9).alias("price_cents"), F.lit(None).cast("string").alias("description"),
            F.lit(None).cast("string").alias("user_data_field"), F.lit(True).alias("graded"),
            F.lit("{}").alias("properties_hash"), F.col("id").alias("seq"))

    def read(_, path, **__):
        files.append(len([f for f in glob.glob(f"{path}/**", recursive=True) if not f.endswith("_SUCCESS")]))
        exports.append(real(spark, path, multiline=False).select("user_id", "id").distinct().collect())
        raise Stop

    real = flows.rd.read_export
    monkeypatch.setattr(flows.rd, "read_export", read)
    for sellers in (5, 100):
        monkeypatch.setattr(flows.fx, "full_export", lambda *_, n=sellers: rows(n))
        if name == "import_lifecycle":  # it answers for a failed import
            flows.import_lifecycle(spark, SF_DIR)
        else:
            with pytest.raises(Stop):
                flows.QUERIES[name][0](spark, SF_DIR)
        assert {(r.user_id, r.id) for r in exports[-1]} == {(str(i % sellers) if i > 3 else None, i) for i in range(200)}
    assert files[1] <= files[0] + 4


def test_an_import_carries_only_what_it_uses(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jobs, "cut", lambda frame, _: seen.extend(frame.columns) or stop())
    path = flows._export_files(spark, SF_DIR)
    with pytest.raises(Stop):
        jobs.run_import(spark, path, "", "", multiline=False)
    assert "seq" in seen and not {"source_file", "expansion_id", "description"} & set(seen)


def test_events_are_judged_once(spark, monkeypatch):
    taken = []
    real = order_flow.cut if hasattr(order_flow, "cut") else None
    monkeypatch.setattr(order_flow, "cut", lambda frame, label: taken.append(label) or real(frame, label), raising=False)
    events = spark.createDataFrame([("a", USER, "", "{}"), ("b", "x", "", "{}"), ("c", None, "", "{}")],
                                   "id string, user_id string, signature string, body string")
    pads = spark.createDataFrame([(USER, "s", b"i", b"o")],
                                 "user_id string, webhook_secret string, inner_pad binary, outer_pad binary")
    accepted, rejected = order_flow.accept_events(events, pads)
    assert sorted(r.id for r in accepted.collect()) == ["a", "c"]
    assert [(r.id, r.message) for r in rejected.collect()] == [("b", "Invalid user_id format: x")]
    assert taken == ["judged"]


def test_sizes_of_tasks_are_set_unless_given(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    configure(session)
    assert session.conf.get("spark.sql.files.maxPartitionBytes") in ("1m", "1048576b")
    assert session.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") in ("16m", "16777216b")


def test_uuids_in_their_normal_form_stay(spark):
    forms = [USER, USER.upper(), "{" + USER + "}", f"urn:uuid:{USER}", USER.replace("-", ""), USER + "\n", USER[:-1], "", None]
    rows = spark.createDataFrame([(f,) for f in forms], "t string").select(canonical_uuid(F.col("t"))).collect()
    assert [r[0] for r in rows] == [USER] * 5 + [USER + "\n", None, None, None]


PATCH = ("item_id long, user_id string, quantity int, price_cents int, description string, user_data_field string, "
         "graded boolean, properties string, seq int")


def stored_items(spark, path, rows):
    """Rows of id, user_id, quantity."""
    items = [(i, user, 1, quantity, 100, '{"condition":"NM"}', str(k), None, None, None, None, None)
             for k, (i, user, quantity) in enumerate(rows)]
    snapshots.write_inventory(spark.createDataFrame(items, schemas.INVENTORY), path, 1, buckets=4)


def quantity_patches(spark, rows):
    return spark.createDataFrame([(i, user, quantity, None, None, None, None, None, 1) for i, user, quantity in rows], PATCH)


def exchanges(node, column):
    """Shuffles in a physical plan that carry a column."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return exchanges(node.initialPlan(), column)
    names = [node.output().apply(k).name() for k in range(node.output().size())]
    own = node.nodeName() == "Exchange" and column in names
    return own + sum(exchanges(node.children().apply(k), column) for k in range(node.children().size()))


def test_an_edit_moves_the_inventory_once(spark, tmp_path, monkeypatch):
    path, found = str(tmp_path / "inventory"), []
    stored_items(spark, path, [(n, f"seller-{n % 9}", 5) for n in range(90)])
    patches = quantity_patches(spark, [(n, f"seller-{n % 9}", 7) for n in range(0, 90, 10)])

    def seen(write):
        def run(self, *args, **kwargs):
            found.append(exchanges(self._df._jdf.queryExecution().executedPlan(), "external_stock_id"))
            return write(self, *args, **kwargs)
        return run

    for name in ("parquet", "json"):
        monkeypatch.setattr(DataFrameWriter, name, seen(getattr(DataFrameWriter, name)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with patches too large to be sent to all tasks
    try:
        jobs.run_edits(spark, patches, path, str(tmp_path / "outbox"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(found) == 1
    got = {r.id: r.quantity for r in snapshots.read_snapshot(spark, path, schemas.INVENTORY).collect()}
    assert got == {n: 5 if n % 10 else 7 for n in range(90)}
    assert sorted(r.item_id for r in spark.read.json(f"{tmp_path}/outbox/update=2").collect()) == list(range(0, 90, 10))


def test_an_edit_of_repeated_and_missing_keys(spark, tmp_path):
    path = str(tmp_path / "inventory")
    stored_items(spark, path, [(1, "u", 5), (1, "u", 6), (1, "v", 5), (2, "u", 6), (3, "u", 5), (4, None, 5), (4, None, 5),
                               (None, "u", 5), (None, "u", 5), (None, None, 5)])
    jobs.run_edits(spark, quantity_patches(spark, [(1, "u", 6), (2, "u", 6), (3, "v", 9), (4, None, 9), (None, "u", 9),
                                                   (None, None, 9), (5, "u", 9)]), path, str(tmp_path / "outbox"))
    rows = snapshots.read_snapshot(spark, path, schemas.INVENTORY).collect()
    assert sorted(((r.id or 0, r.user_id or "", r.quantity, r.updated_at is not None) for r in rows)) == [
        (0, "", 5, False), (0, "u", 5, False), (0, "u", 5, False), (1, "u", 6, True), (1, "u", 6, True), (1, "v", 5, False),
        (2, "u", 6, True), (3, "u", 5, False), (4, "", 5, False), (4, "", 5, False)]
    # One of the rows with id 1 has changed: all of them are sent.
    sent = spark.read.json(f"{tmp_path}/outbox/update=2").collect()
    assert sorted((r.item_id, r.user_id) for r in sent) == [(1, "u"), (1, "u"), (1, "v")]


def test_an_edit_writes_a_large_seller_by_several_tasks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "inventory")
    stored_items(spark, path, [(n, "u", 5) for n in range(200)] + [(None, "u", n) for n in range(200)])
    monkeypatch.setattr(snapshots, "SLICE_ROWS", 25, raising=False)
    monkeypatch.setattr(snapshots, "TASK_ROWS", 25, raising=False)
    jobs.run_edits(spark, quantity_patches(spark, [(n, "u", 6) for n in range(200)]), path, str(tmp_path / "outbox"))
    after = snapshots.read_snapshot(spark, path, schemas.INVENTORY)
    assert len(after.inputFiles()) > 4
    assert sorted(r.quantity for r in after.where("id IS NOT NULL").collect()) == [6] * 200
    assert sorted(r.quantity for r in after.where("id IS NULL").collect()) == list(range(200))
    spread = after.where("id IS NULL").groupBy(F.input_file_name()).count().collect()
    assert len(spread) > 4  # rows without an id are not all one task's


@pytest.mark.parametrize("name", ["edit_job", "delete_job"])
def test_requests_come_from_the_stored_inventory(spark, monkeypatch, name):
    derived = []
    real = flows.fx.full_inventory
    monkeypatch.setattr(flows.fx, "full_inventory", lambda *args: derived.append(1) or real(*args))
    assert flows.QUERIES[name][0](spark, SF_DIR).count() > 0
    assert len(derived) == 1
