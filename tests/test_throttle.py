import random

import pytest
from pyspark.sql import functions as F

from stockline.operators import telemetry as tm
from stockline.operators import throttle as th


def _log(spark, rows):
    frame = spark.createDataFrame(rows, "user_id string, request_id long, at long, status_code int")
    return frame.withColumn("ts", F.timestamp_micros("at")).drop("at")


def _bucket(rows, limit, window):
    answers, start, used = {}, {}, {}
    for user, request, at, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if user not in start or at >= start[user] + window:
            start[user], used[user] = at, 0
        if used[user] < limit:
            used[user] += 1
            answers[request] = (True, None)
        else:
            answers[request] = (False, (start[user] + window - at) / 1e6)
    return answers


@pytest.mark.parametrize("slice_windows", [1, 4, 60])
def test_bucket_equals_one_by_one(spark, slice_windows):
    rng = random.Random(slice_windows)
    rows = [("hot" if i % 3 else rng.choice("abcdef"), i, 1_700_000_000_000_000 + rng.randint(0, 400_000_000), 200)
            for i in range(3000)]
    got = {r.request_id: (r.allowed, r.wait_seconds)
           for r in th.throttle_audit(_log(spark, rows), 20, 10, slice_windows).collect()}
    assert got == _bucket(rows, 20, 10_000_000)


def test_first_request_allowed_and_empty_bucket_waits(spark):
    rows = [("u", 1, 10_000_000, 200), ("u", 2, 11_000_000, 200), ("u", 3, 20_000_000, 200)]
    got = {r.request_id: (r.allowed, r.wait_seconds) for r in th.throttle_audit(_log(spark, rows), 1, 10).collect()}
    assert got == {1: (True, None), 2: (False, 9.0), 3: (True, None)}


def _factors(rows):
    answers, factor, changed, hits = {}, {}, {}, {}
    for user, request, at, code in sorted(rows, key=lambda r: (r[2], r[1])):
        if code != 429 and code >= 400:
            continue
        now = factor.get(user, 1.0)
        if user in changed and at - changed[user] >= 3600_000_000:
            now = 1.0
        if code == 429:
            now = max(0.5, now * 0.9)
            changed[user] = hits[user] = at
        elif at - hits.get(user, -10**18) >= 300_000_000 and now < 1.0:
            now = min(1.5, now * 1.01)
            changed[user] = at
        factor[user] = now
        answers[request] = now
    return answers


def test_factor_equals_one_by_one(spark):
    rng = random.Random(5)
    rows, at, number = [], 1_700_000_000_000_000, 0
    for _ in range(40):
        # Bursts of 429s, long runs of successes, and pauses of more than an hour.
        kind = rng.choice(["burst", "calm", "mixed", "pause"])
        if kind == "pause":
            at += rng.randint(3_500_000_000, 9_000_000_000)
            continue
        for _ in range(rng.randint(5, 120)):
            at += rng.randint(1_000_000, 40_000_000)
            code = 429 if kind == "burst" else 200 if kind == "calm" else rng.choice([200, 200, 200, 429, 500])
            rows.append(("hot" if number % 3 else rng.choice("abc"), number, at, code))
            number += 1
    got = {r.request_id: r.factor for r in th.adaptive_limits(_log(spark, rows)).collect()}
    assert got == _factors(rows)
    assert min(got.values()) == 0.5


def test_recent_throttles_window(spark):
    base = 1_700_000_000_000_000
    rows = [("u", i, base + i * 1_000_000, 429) for i in range(150)]
    rows += [("u", 1000, base + 310_000_000, 200), ("u", 1001, base + 449_000_000, 200), ("v", 1002, base, 200)]
    got = {r.request_id: r.recent_429s for r in tm.recent_throttles(_log(spark, rows)).collect()}
    assert got[0] == 1 and got[50] == 51 and got[149] == 150
    # At 310 s, the 429s of seconds 11 to 149 count; at 449 s the last one is exactly 300 s old.
    assert got[1000] == 139 and got[1001] == 0 and got[1002] == 0
    assert len(got) == len(rows)


def test_outage_opens_at_the_fifth_failure(spark):
    base = 1_700_000_000_000_000
    times = [0, 10, 20, 30, 40, 50, 110, 120]
    rows = [("u", i, base + t * 1_000_000, 500 if i % 2 else 404) for i, t in enumerate(times)]
    rows.append(("u", 99, base + 55_000_000, 429))
    (row,) = tm.outage_sessions(_log(spark, rows)).collect()
    seconds = [int(x.timestamp()) - 1_700_000_000 for x in (row.started_at, row.opened_at, row.ended_at)]
    # 110 s is exactly one gap after 50 s: a new stretch, too short to open.
    assert seconds == [0, 40, 50] and row.failures == 6


def test_percentiles_are_exact(spark):
    rng = random.Random(2)
    values = [round(rng.expovariate(1), 4) for _ in range(997)]
    frame = spark.createDataFrame([("e", v) for v in values], "endpoint string, duration_s double")
    row = tm.exact_percentiles(frame, ["endpoint"], "duration_s").first()
    ranked = sorted(values)
    assert (row.p50, row.p95, row.p99) == (ranked[498], ranked[947], ranked[987])
