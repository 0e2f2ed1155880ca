"""Streams of late rows against the batch form, and events without an id."""

import json
import random

import pytest
from pyspark.sql import functions as F

from stockline.operators import events as ev
from stockline.operators.ledger import stock_ledger
from stockline.plans.order_flow import event_answers, event_deltas
from stockline.sources import readers as rd
from stockline.streaming import service as sv
from stockline.streaming import stock as st

USER = "db24fb13-ec73-49b8-932c-f0043dd47e86"
OTHER = "0b24fb13-ec73-49b8-932c-f0043dd47e86"
REQUESTS = "request_id long, endpoint string, t long, status_code int, user_id long"


def requests(seed, n=400):
    """Rows over three days, in an order that has nothing to do with their times."""
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b"]), rng.choice([rng.randrange(86_400 * 3), 86_400 + rng.randrange(-300, 300)]),
             rng.choice([200, 200, 500, 429, 404, None]), 1) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, REQUESTS).withColumn("ts", F.timestamp_seconds("t"))


REPORTS = {"alerts": lambda: sv.alert_report("1 hour", None, 0.3, 2),
           "sliding": lambda: sv.alert_report("1 hour", "30 minutes", 0.3, 2),
           "outages": lambda: sv.outage_report(["endpoint"], 600, 3)}


@pytest.mark.parametrize("name", list(REPORTS))
def test_late_rows_count_as_in_batch(spark, tmp_path, name):
    report, rows, folder = REPORTS[name](), requests(5), tmp_path / "in"
    for k in range(5):
        frame(spark, rows[80 * k:80 * k + 80]).coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(frame(spark, rows[:1]).schema).parquet(str(folder))
        sv.run_report(stream, report, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        got = sv.report_rows(spark, stream.schema, report, str(tmp_path / "out"))
        batch = report.batch(frame(spark, rows[:80 * k + 80]))
        assert sorted(got.select(batch.columns).collect()) == sorted(batch.collect()) != []
    updates = spark.read.parquet(str(tmp_path / "out" / "updates"))
    assert updates.where("batch = 0 and revised").count() == 0 < updates.where("batch = 4 and revised").count()
    days = [p for p in (tmp_path / "out" / "days").glob("of_day=*/batch=*")]
    assert len(days) <= 2 * len({p.parent for p in days})


def test_a_repeated_trigger_changes_nothing(spark, tmp_path):
    """A trigger that is run again reads what was there before it, not what it wrote itself."""
    report, rows = REPORTS["alerts"](), requests(6, 60)
    table = sv.DayTable(str(tmp_path / "days"), sv._schema(frame(spark, rows[:1]), report))
    for batch in (0, 1, 1):
        part = report.partial(frame(spark, rows[30 * batch:30 * batch + 30]))
        days = [r[0] for r in part.select("day").distinct().collect()]
        table.write(report.merge(table.read(spark, days, batch).unionByName(part)), batch)
    got = report.shown(table.latest(spark))
    assert sorted(got.collect()) == sorted(report.batch(frame(spark, rows)).collect())


def line(number, seller, name, items, at=None):
    body = {"id": name, "cause": "order.create", "mode": "live",
            "data": {"id": number, "state": "paid", "seller": {"id": seller}, "order_items": items}}
    return json.dumps({"received_at": f"2024-01-01T00:00:{at or number:02d}Z", "user_id": None, "signature": "",
                       "body": json.dumps(body)})


def inventory(spark):
    return spark.createDataFrame([(1, USER, "7", 5), (2, OTHER, "8", 9)],
                                 "id long, user_id string, external_stock_id string, quantity int")


@pytest.fixture
def feed(tmp_path):
    """Three events without an id (sellers 1, 2, 1), one of them twice in the same words, and one id for two sellers."""
    one, two = [{"product_id": "7", "quantity": 1}], [{"product_id": "8", "quantity": 2}]
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([line(1, USER, None, one), line(2, OTHER, None, two), line(3, USER, None, one),
                                              line(3, USER, None, one), line(4, USER, "x", one), line(5, OTHER, "x", two),
                                              line(4, USER, "x", one, 9)]))
    return str(folder)


def test_answers_to_events_without_an_id(spark, feed):
    events = ev.dedupe_events(rd.read_order_events(spark, feed, stream=False))
    assert events.count() == 6 == events.select("event_key", "data.seller.id").distinct().count()
    results = ev.event_results(stock_ledger(event_deltas(events), inventory(spark), ev.LINE_ORDER))
    answers = sorted((r.webhook_id, r.order_id, r.items_processed, [(i.product_id, i.new_quantity) for i in r["items"]])
                     for r in event_answers(events, results).collect())
    assert answers == [("unknown", 1, 1, [("7", 4)]), ("unknown", 2, 1, [("8", 7)]), ("unknown", 3, 1, [("7", 2)]),
                       ("unknown", 3, 1, [("7", 3)]), ("x", 4, 1, [("7", 1)]), ("x", 5, 1, [("8", 5)])]


def test_stream_of_events_without_an_id(spark, feed, tmp_path):
    deltas = st.stream_deltas(rd.read_order_events(spark, feed))
    out = str(tmp_path / "out")
    st.stream_stock_ledger(deltas, inventory(spark), out, str(tmp_path / "checkpoint")).awaitTermination()
    rows = spark.read.parquet(f"{out}/ledger").collect()
    assert len(rows) == 6 == len({(r.event_id, r.user_id) for r in rows})
    settled = {r.external_stock_id: r.quantity for r in st.settled_inventory(inventory(spark), out).collect()}
    assert settled == {"7": 1, "8": 5}
