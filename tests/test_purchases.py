import random

from pyspark.sql import functions as F

from stockline.operators import purchases as pu


def _walk(requests, items):
    answers = {}
    state = {item: [local, remote] for item, (stock, local, remote) in items.items()}
    for request, item, n, ts in sorted(requests, key=lambda r: (r[3], r[0])):
        if item not in items:
            answers[request] = ("not_found", None, None, None)
            continue
        stock, local, remote = items[item][0], *state[item]
        if stock is None:
            answers[request] = ("error", local, local, None)
        elif local < n or remote < n:
            state[item][0] = remote
            answers[request] = ("error", local, remote, None)
        else:
            state[item] = [local - n, remote - n]
            answers[request] = ("success", local, local - n, "increment" if remote > n else "delete")
    return answers


def _run(spark, requests, items):
    inventory = spark.createDataFrame(
        [(i, "u", s, local) for i, (s, local, _) in items.items()],
        "id long, user_id string, external_stock_id string, quantity int")
    export = spark.createDataFrame(
        [("u", int(s), remote) for s, _, remote in items.values() if s is not None],
        "user_id string, id long, quantity int")
    frame = spark.createDataFrame([(r, i, "u", n, t) for r, i, n, t in requests],
                                  "request_id long, item_id long, user_id string, quantity int, t long")
    decided = pu.decide_purchases(frame.withColumn("ts", F.timestamp_seconds("t")).drop("t"), inventory, export)
    return inventory, decided


def test_decisions_equal_one_by_one(spark):
    rng = random.Random(11)
    items = {i: (str(1000 + i) if i % 7 else None, rng.randint(0, 60), rng.randint(0, 60)) for i in range(60)}
    # A third of the requests want item 1, which has far more stock on one side than on the other.
    items[1] = ("1001", 400, 900)
    items[2] = ("1002", 900, 300)
    requests = [(i, 1 if i % 3 == 0 else rng.choice([2, *range(65)]), rng.choice([1, 2, 3, 7, 19, 60]),
                 1_000_000 + rng.randint(0, 300) * 900) for i in range(2500)]
    inventory, decided = _run(spark, requests, items)
    got = {r.request_id: (r.status, r.quantity_before, r.quantity_after, r.remote_action) for r in decided.collect()}
    expected = _walk(requests, items)
    assert got == expected
    last = {}
    for request, item, _, ts in sorted(requests, key=lambda r: (r[3], r[0])):
        if expected[request][2] is not None:
            last[item] = expected[request][2]
    settled = {r.id: r.quantity for r in pu.settle_purchases(inventory, decided).collect()}
    assert settled == {i: last.get(i, local) for i, (_, local, _) in items.items()}


def test_error_texts(spark):
    items = {1: ("11", 5, 3), 2: (None, 5, 0)}
    requests = [(1, 1, 9, 10), (2, 1, 4, 20), (3, 2, 9, 10), (4, 2, 1, 20), (5, 9, 1, 10)]
    _, decided = _run(spark, requests, items)
    errors = {r.request_id: r.error for r in decided.collect()}
    assert errors == {
        1: "Insufficient quantity. Available: 3, Requested: 9",
        2: "Insufficient quantity. Available: 3, Requested: 4",
        3: "Insufficient quantity. Available: 5, Requested: 9",
        4: "Missing external_stock_id",
        5: "Inventory item not found",
    }
    _, decided = _run(spark, [(1, 1, 4, 10)], items)
    assert decided.first().error == "Insufficient quantity on marketplace. Available: 3, Requested: 4"


def test_availability(spark):
    ids = spark.createDataFrame([("u", "1"), ("u", "2"), ("u", "x"), ("u", "03")], "user_id string, external_stock_id string")
    export = spark.createDataFrame([("u", 1, 4), ("u", 2, 0), ("u", 3, 1)], "user_id string, id long, quantity int")
    got = {r.external_stock_id: (r.available, r.quantity, r.error) for r in pu.check_availability(ids, export).collect()}
    assert got == {"1": (True, 4, None), "2": (False, 0, None), "x": (False, 0, "Product x not found in inventory"),
                   "03": (True, 1, None)}
