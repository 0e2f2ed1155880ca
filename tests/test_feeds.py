"""A feed is read once, however events are told apart."""

import json
import os

from pyspark.sql import functions as F

from stockline.operators import events as ev
from stockline.session import configure, cut, stream_session
from stockline.sources import readers
from stockline.streaming import sinks
from stockline.streaming import stock as st

USER = "db24fb13-ec73-49b8-932c-f0043dd47e86"


def feed(folder, ids, seller=USER):
    """One line an id; those that are null have none."""
    folder.mkdir(exist_ok=True)
    bodies = [{"id": i, "cause": "order.create", "data": {"id": 1, "state": "paid", "seller": {"id": seller}, "order_items": [
        {"product_id": "7", "quantity": 1}]}} for i in ids]
    lines = [json.dumps({"received_at": "2024-01-01T12:00:00Z", "signature": "", "body": json.dumps(b)}) for b in bodies]
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(lines))


def scans(frame):
    return frame._jdf.queryExecution().analyzed().collectLeaves().size()


def test_a_stream_reads_its_feed_once(spark, tmp_path):
    folder, out, session = tmp_path / "feed", str(tmp_path / "out"), stream_session(spark, 2)
    feed(folder, ["a", "a", None, None, "b"])
    feed(folder, ["a", "unknown"], "other")
    for _ in range(2):  # the second trigger sends known events again, and one without an id
        events = st.dedupe_stream(readers.read_order_events(session, str(folder)))
        assert scans(events) == 1
        sinks.run_available(events.select("id"), out, str(tmp_path / "checkpoint"))
        feed(folder, ["a", "b", None])
    got = sorted(r.id for r in spark.read.schema("id string").parquet(out).collect())
    assert got == ["a", "a", "b"] + ["unknown"] * 4


def test_no_trigger_goes_without_data(spark, tmp_path):
    folder, session, seen = tmp_path / "feed", stream_session(spark, 2), []
    feed(folder, ["a", "b"])
    events = st.dedupe_stream(readers.read_order_events(session, str(folder)))
    query = (events.writeStream.foreachBatch(lambda batch, number: seen.append(batch.count()))
             .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start())
    query.awaitTermination()
    assert seen == [2]


def test_a_batch_reads_its_feed_once(spark, tmp_path):
    feed(tmp_path / "feed", ["a", "a", None, None, "unknown"])
    feed(tmp_path / "feed", ["a"], "other")
    kept = ev.dedupe_events(readers.read_order_events(spark, str(tmp_path / "feed"), stream=False))
    assert scans(kept) == 1
    assert sorted(r.id for r in kept.collect()) == ["a", "a", "unknown", "unknown", "unknown"]


def test_nothing_shuffled_stays_after_a_query(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for folder in manager.localDirsString() for _, _, names in os.walk(folder) for name in names
                if name.startswith("shuffle_")}

    before = shuffled()
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    assert cut(rows, "groups").count() == 7
    assert sorted(rows.collect()) == sorted(rows.collect())
    assert not shuffled() - before


def test_many_folders_are_listed_by_few_tasks(spark, tmp_path):
    session, context = spark.newSession(), spark.sparkContext
    configure(session)
    session.range(200).selectExpr("id", "id % 100 AS b").write.partitionBy("b").parquet(str(tmp_path / "rows"))
    context.setJobGroup("listing", "")
    try:
        session.read.schema("id long").parquet(*[f"{tmp_path}/rows/b={k}" for k in range(100)])
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(job).stageIds]
    assert stages and sum(tracker.getStageInfo(s).numTasks for s in stages) <= 32
