"""Slices, stretches and selection for keys that hold very many rows close together."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline.operators import ledger, scan, sessions, telemetry
from stockline.operators.scan import SLICE, Running, place, running, time_slice


def crowded(spark, n=20_000, seed=4):
    """A third of the rows belong to one key, all of them in one hour and half of them at one moment."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            rows.append((0, 7200 + (0 if i % 2 else rng.randrange(3600)), i, rng.randint(-9, 9)))
        else:
            rows.append((rng.choice([None, *range(1, 300)]), rng.choice([None, rng.randrange(10**6)]), i, rng.randint(-9, 9)))
    frame = spark.createDataFrame(rows, "k int, t long, id long, v long")
    return frame.withColumn("ts", F.timestamp_seconds("t")).repartition(6)


def test_a_crowded_hour_is_cut_evenly(spark):
    rows = crowded(spark)
    placed = place(rows, ["k"], ["ts", "id"], time_slice(F.col("ts")), 500)
    assert sorted(placed.drop(SLICE).collect(), key=str) == sorted(rows.collect(), key=str)
    sizes = [r["count"] for r in placed.where("k = 0").groupBy(SLICE).count().collect()]
    assert sum(sizes) == 6667 and len(sizes) >= 20
    assert max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert placed.where("k != 0").groupBy("k", SLICE).count().agg(F.max("count")).first()[0] <= 500
    # Slices rise with the order.
    ends = (placed.where("k = 0").groupBy(SLICE).agg(F.min(F.struct("ts", "id")).alias("a"), F.max(F.struct("ts", "id")).alias("b"))
            .orderBy(SLICE).collect())
    assert all(x.b < y.a for x, y in zip(ends, ends[1:], strict=False))


def test_running_totals_over_cut_hours(spark):
    rows = crowded(spark)
    placed = place(rows, ["k"], ["ts", "id"], time_slice(F.col("ts")), 300)
    scanned = running(placed, ["k"], ["ts", "id"], None, {"total": Running("sum", F.col("v")), "top": Running("max", F.col("v"), False)})
    upto = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy("k").orderBy("ts", "id").rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select("*", F.sum("v").over(upto).alias("total"), F.max("v").over(past).alias("top"))
    assert sorted(scanned.drop(SLICE).select(plain.columns).collect(), key=str) == sorted(plain.collect(), key=str)


def test_without_crowds_nothing_is_cut(spark):
    placed = place(crowded(spark, 300), ["k"], ["ts", "id"], time_slice(F.col("ts")))
    assert placed.where(F.col(SLICE) != time_slice(F.col("ts"))).count() == 0
    assert place(placed, ["k"], ["ts", "id"], time_slice(F.col("ts"))) is placed


def test_ledger_of_a_hot_item(spark, monkeypatch):
    """All changes of an item in one hour: the same as one by one."""
    rng = random.Random(8)
    rows = [("u", "hot" if i % 2 else f"i{i % 7}", rng.randint(-9, 9), 7200 + i % 5, f"e{i:05d}") for i in range(4000)]
    deltas = spark.createDataFrame(rows, "user_id string, external_stock_id string, delta long, t long, event_id string")
    deltas = deltas.withColumn("ts", F.timestamp_seconds("t"))
    names = ["hot", *[f"i{k}" for k in range(7)]]
    items = spark.createDataFrame([(k, "u", n, 20) for k, n in enumerate(names)],
                                  "id long, user_id string, external_stock_id string, quantity int")
    monkeypatch.setattr(scan, "SLICE_ROWS", 100)
    got = {r.event_id: (r.old_quantity, r.new_quantity) for r in ledger.stock_ledger(deltas, items, ["ts", "event_id"]).collect()}
    stock = dict.fromkeys(names, 20)
    for _, item, delta, _, event in sorted(rows, key=lambda r: (r[3], r[4])):
        old, stock[item] = stock[item], max(0, stock[item] + delta)
        assert got[event] == (old, stock[item])
    after = {r.external_stock_id: r.quantity for r in ledger.apply_deltas(items, deltas, ["ts", "event_id"]).collect()}
    assert after == stock


def brute_stretches(times, gap, firsts):
    found = []
    for t in sorted(times):
        if found and t - found[-1][-1] < gap:
            found[-1].append(t)
        else:
            found.append([t])
    return sorted((s[0], s[-1], len(s), tuple(s[:firsts])) for s in found)


@pytest.mark.parametrize("most, firsts", [(10**6, 3), (50, 5), (7, 1)])
def test_stretches_match_brute_force(spark, monkeypatch, most, firsts):
    monkeypatch.setattr(scan, "SLICE_ROWS", most)
    rng = random.Random(most)
    rows = [("hot", 5000 + rng.randrange(3000), i) for i in range(900)]
    rows += [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(40_000)]), i) for i in range(900, 1500)]
    frame = spark.createDataFrame(rows, "k string, t long, id long").withColumn("ts", F.timestamp_seconds("t"))
    got = sessions.event_stretches(frame, ["k"], 60, ["ts", "id"], firsts)
    for key in ("hot", "a", "b", None):
        mine = sorted((int(r.started_at.timestamp()), int(r.ended_at.timestamp()), r.events, tuple(int(x.timestamp()) for x in r.firsts))
                      for r in got.collect() if r.k == key)
        assert mine == brute_stretches([t for k, t, _ in rows if k == key and t is not None], 60, firsts)


def test_partial_stretches_merge_in_any_deal(spark):
    """Summaries of rows dealt at random, as the triggers of a stream bring them."""
    rng = random.Random(6)
    times = [rng.randrange(9000) for _ in range(250)]
    frame = spark.createDataFrame([(t, i, rng.randrange(4)) for i, t in enumerate(times)], "t long, id long, deal int").withColumn(
        "ts", F.timestamp_seconds("t"))
    merged = None
    for deal in range(4):
        part = sessions.event_stretches(frame.where(F.col("deal") == deal), [], 60, ["ts", "id"], 4)
        both = part if merged is None else merged.unionByName(part)
        merged = spark.createDataFrame(sessions.merge_summaries(both, [], 60, 4).select(*sessions.SUMMARY).collect(), part.schema)
    got = sorted((int(r.started_at.timestamp()), int(r.ended_at.timestamp()), r.events, tuple(int(x.timestamp()) for x in r.firsts))
                 for r in merged.collect())
    assert got == brute_stretches(times, 60, 4)


@pytest.mark.parametrize("few", [1_000_000, 40])
def test_percentiles_of_alike_values(spark, few):
    """All values of an endpoint within a millisecond, and values of any size."""
    rng = random.Random(few)
    values = {"alike": [0.25 + rng.random() / 1000 for _ in range(700)], "same": [1.5] * 300, "one": [7.0],
              "wild": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(400)] + [math.inf, -math.inf],
              None: [float(k % 11) for k in range(200)]}
    rows = [(k, v) for k, of in values.items() for v in of] + [("alike", None), ("alike", math.nan)]
    got = telemetry.exact_percentiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", few=few)
    for r in got.collect():
        of = sorted(values[r.k])
        assert (r.p50, r.p95, r.p99) == tuple(of[math.ceil(len(of) * p) - 1] for p in (0.5, 0.95, 0.99)), r.k
    assert got.count() == len(values)


def test_percentiles_of_a_whole_table(spark):
    rows = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert tuple(telemetry.exact_percentiles(rows, [], "v").first()) == (500.0, 950.0, 990.0)
    assert telemetry.exact_percentiles(rows.where("v < 0").withColumn("k", F.lit(1)), ["k"], "v").count() == 0


def test_last_values_meet_in_two_levels(spark):
    rows = spark.range(5000).select(F.lit("m").alias("name"), (F.col("id") % 3).alias("label"), F.col("id").alias("seq"),
                                    F.timestamp_seconds(F.col("id") % 100).alias("ts"), F.col("id").alias("value"))
    got = telemetry.last_n_values(rows, ["label"], 20, 8)
    latest = Window.partitionBy("label").orderBy(F.desc("ts"), F.desc("seq"))
    plain = rows.withColumn("r", F.row_number().over(latest)).where("r <= 20").drop("r")
    assert sorted(got.collect()) == sorted(plain.select(got.columns).collect())
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    limits = [line for line in plain_lines(plan) if "WindowGroupLimit" in line]
    assert len(limits) == 2 and sum("_share#" in line for line in limits) == 1


def plain_lines(plan):
    return [line.strip() for line in plan.splitlines()]
