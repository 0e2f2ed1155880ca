import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from stockline.operators.scan import Running, number_slice, numbered, running, time_slice
from stockline.plans.bulk import assign_ids


def _rows(spark, n=3000, seed=1):
    """A third of the rows belong to one key."""
    rng = random.Random(seed)
    data = [(0 if i % 3 == 0 else rng.randint(1, 200), rng.randint(0, 10_000), i, rng.randint(-9, 9))
            for i in range(n)]
    return spark.createDataFrame(data, "k int, pos long, id long, v long")


def test_running_equals_plain_window(spark):
    rows = _rows(spark)
    scanned = running(rows, ["k"], ["pos", "id"], number_slice(F.col("pos"), 37), {
        "total": Running("sum", F.col("v")), "before": Running("sum", F.col("v"), False),
        "top": Running("max", F.col("v"), False), "low": Running("min", F.col("v"))})
    w = Window.partitionBy("k").orderBy("pos", "id")
    upto, past = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    plain = rows.select("*", F.sum("v").over(upto).alias("total"),
                        F.coalesce(F.sum("v").over(past), F.lit(0)).alias("before"),
                        F.max("v").over(past).alias("top"), F.min("v").over(upto).alias("low"))
    assert sorted(scanned.collect()) == sorted(plain.select(scanned.columns).collect())


def test_rows_are_only_ordered_inside_slices(spark):
    placed = numbered(_rows(spark), ["k"], ["pos", "id"], number_slice(F.col("pos"), 37))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "windowspecdefinition(k" in line]
    by_rows = [line for line in windows if "pos#" in line.split("windowspecdefinition", 1)[1]]
    assert by_rows and all("_slice#" in line.split("pos#")[0] for line in by_rows)


def test_slices_of_two_parts(spark):
    """All rows share one timestamp; the second part of the slice cuts them."""
    rows = _rows(spark, 600).withColumn("ts", F.timestamp_seconds(F.lit(1000)))
    cut = F.struct(time_slice(F.col("ts")), number_slice(F.col("id"), 50))
    placed = numbered(rows, ["k"], ["ts", "id"], cut).collect()
    hot = sorted((r for r in placed if r.k == 0), key=lambda r: r.id)
    assert [r.position for r in hot] == list(range(1, len(hot) + 1))


def test_running_over_everything(spark):
    rows = _rows(spark, 500)
    scanned = numbered(rows, [], ["pos", "id"], number_slice(F.col("pos"), 100))
    ordered = [r.id for r in sorted(rows.collect(), key=lambda r: (r.pos, r.id))]
    assert [r.id for r in sorted(scanned.collect(), key=lambda r: r.position)] == ordered


def test_running_with_times(spark):
    rows = _rows(spark, 500).withColumn("ts", F.timestamp_seconds("pos"))
    scanned = numbered(rows, ["k"], ["ts", "id"], time_slice(F.col("ts"), 60))
    for key in (0, 5):
        mine = sorted((r for r in scanned.collect() if r.k == key), key=lambda r: (r.pos, r.id))
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))


def test_assign_ids_is_dense_and_stable(spark):
    rows = spark.range(200).select(
        F.when(F.col("id") < 50, F.col("id")).alias("id"), F.lit("u").alias("user_id"),
        F.col("id").alias("blueprint_id"), F.col("id").cast("string").alias("external_stock_id"))
    first = {r.blueprint_id: r.id for r in assign_ids(rows, 1000).collect()}
    again = {r.blueprint_id: r.id for r in assign_ids(rows.repartition(7), 1000).collect()}
    assert first == again
    assert sorted(v for k, v in first.items() if k >= 50) == list(range(1000, 1150))
