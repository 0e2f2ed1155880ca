"""Replay of rate limits over a request log."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from stockline.operators.scan import Running, numbered, running, time_slice
from stockline.operators.telemetry import gap_sessions, is_success
from stockline.session import cut

REQUEST_LIMIT = 200
WINDOW_SECONDS = 10

# How the limit adapts, and for how long (seconds) its state lasts.
MIN_FACTOR = 0.5
MAX_FACTOR = 1.5
REDUCTION = 0.9
INCREASE = 1.01
CALM_SECONDS = 300
MEMORY_SECONDS = 3600

# From the lowest factor, 70 increases reach 1.0; from the highest, 7 reductions reach the floor.
STEPS_UP = 70
STEPS_DOWN = 7

_ORDER = ["ts", "request_id"]
_ALWAYS = -(2 ** 62)
_LONGS = ArrayType(LongType())


# --- token bucket -----------------------------------------------------------------------------

def _following(times: np.ndarray, window: int) -> np.ndarray:
    """Per request, the index of the first request at least one window later."""
    return np.searchsorted(times, times + window, side="left")


def _slice_exits(times: np.ndarray, entry_limit: int, window: int) -> tuple[list, list]:
    """What one slice does to the time at which the next bucket may start.

    Buckets that start at different requests soon run into the same later ones. For each start that
    the slice before may leave open (before ``entry_limit``) the answer lists the latest time it is
    free and the time at which the bucket after it, and so on to the end of the slice, is free.
    """
    count = len(times)
    last = _following(times, window)
    last = np.where(last == count, np.arange(count), last)
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    reach = min(int(np.searchsorted(times, entry_limit, side="left")) + 1, count)
    ends = times[last[:reach]] + window
    final = np.append(ends[1:] != ends[:-1], True)
    return times[:reach][final], ends[final]


def _bucket_starts(times: np.ndarray, free_at: int, window: int) -> np.ndarray:
    """Start of the bucket each request of a slice falls into."""
    following = _following(times, window)
    starts, position = [free_at - window], int(np.searchsorted(times, free_at, side="left"))
    while position < len(times):
        starts.append(times[position])
        position = following[position]
    return np.array(starts)[np.searchsorted(starts, times, side="right") - 1]


@F.pandas_udf(StructType([StructField("upto", _LONGS), StructField("after", _LONGS)]))
def _exits_udf(times: pd.Series, entry_limit: pd.Series, window: pd.Series) -> pd.DataFrame:
    pairs = [_slice_exits(np.asarray(t), e, w) for t, e, w in zip(times, entry_limit, window)]
    return pd.DataFrame({"upto": [u for u, _ in pairs], "after": [a for _, a in pairs]})


@F.pandas_udf(_LONGS)
def _entries_udf(upto: pd.Series, after: pd.Series) -> pd.Series:
    """Walk each user's slices in order: when a new bucket may start, on entry to each slice."""
    walked = []
    for uptos, afters in zip(upto, after):
        free_at, entered = _ALWAYS, []
        for bounds, ends in zip(uptos, afters):
            entered.append(free_at)
            position = int(np.searchsorted(bounds, free_at, side="left"))
            if position < len(bounds):
                free_at = int(ends[position])
        walked.append(entered)
    return pd.Series(walked)


@F.pandas_udf(_LONGS)
def _starts_udf(times: pd.Series, free_at: pd.Series, window: pd.Series) -> pd.Series:
    return pd.Series([_bucket_starts(np.asarray(t), f, w) for t, f, w in zip(times, free_at, window)])


def throttle_audit(requests: DataFrame, limit: int = REQUEST_LIMIT, window_seconds: int = WINDOW_SECONDS,
                   slice_windows: int = 60) -> DataFrame:
    """Which requests exceed the budget: a bucket of ``limit`` tokens starts at a user's first request
    and is full again at the first request one window later.

    Where a bucket starts depends on all buckets before it. A user's log is cut into slices of
    ``slice_windows`` windows; each slice is reduced, on its own, to the map from "free again at" on
    entry to the same on exit, and only those short maps of a user are walked in order.
    """
    window = window_seconds * 1_000_000
    width = window * slice_windows
    at = F.unix_micros("ts")
    # One row per user and slice; its log is as long as the slice, whatever the user's log is.
    slices = cut(requests.select("user_id", F.struct(at.alias("at"), "request_id").alias("r"),
                                 F.floor(at / F.lit(width)).alias("slice"))
                 .groupBy("user_id", "slice").agg(F.array_sort(F.collect_list("r")).alias("log")), "slices")
    times = F.col("log.at")
    exits = slices.select("user_id", "slice", _exits_udf(
        times, F.col("slice") * width + window, F.lit(window)).alias("e"))
    ordered = exits.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.struct("slice", "e.upto", "e.after"))).alias("s"))
    carried = ordered.select("user_id", F.inline(F.arrays_zip(
        F.col("s.slice").alias("slice"), _entries_udf("s.upto", "s.after").alias("free_at"))))
    entry = F.coalesce("free_at", F.lit(_ALWAYS))
    placed = (slices.join(carried.toDF("user_id", "slice", "free_at"), ["user_id", "slice"], "left")
              .select("user_id", "log", _starts_udf(times, entry, F.lit(window)).alias("buckets"))
              .select("user_id", F.explode(F.arrays_zip("log", "buckets")).alias("z"))
              .select("user_id", "z.log.request_id", "z.log.at", F.col("z.buckets").alias("bucket")))
    turn = Window.partitionBy("user_id", "bucket").orderBy("at", "request_id")
    allowed = F.row_number().over(turn) <= limit
    return placed.select(
        "user_id", "request_id", F.timestamp_micros("at").alias("ts"), F.timestamp_micros("bucket").alias("bucket_start"),
        allowed.alias("allowed"),
        F.when(~allowed, (F.col("bucket") + window - F.col("at")) / F.lit(1_000_000.0)).alias("wait_seconds"))


# --- adaptive factor --------------------------------------------------------------------------

def _walk_factor(at: np.ndarray, hit: np.ndarray, last_hit: np.ndarray) -> tuple[list, list]:
    """Factor, and time of its last change, after each moving request of one user."""
    factor, changed = 1.0, _ALWAYS
    factors, changes = [], []
    for now, lowers, before in zip(at, hit, last_hit):
        changed = max(changed, before)
        if now - changed >= MEMORY_SECONDS * 1_000_000:
            factor = 1.0
        if lowers:
            factor, changed = max(MIN_FACTOR, factor * REDUCTION), now
        elif factor < 1.0:
            factor, changed = min(MAX_FACTOR, factor * INCREASE), now
        factors.append(factor)
        changes.append(changed)
    return factors, changes


@F.pandas_udf(StructType([StructField("factor", ArrayType(DoubleType())), StructField("changed", _LONGS)]))
def _factor_udf(at: pd.Series, hit: pd.Series, last_hit: pd.Series) -> pd.DataFrame:
    pairs = [_walk_factor(*row) for row in zip(at, hit, last_hit)]
    return pd.DataFrame({"factor": [f for f, _ in pairs], "changed": [c for _, c in pairs]})


def adaptive_limits(requests: DataFrame, base: int = REQUEST_LIMIT) -> DataFrame:
    """Factor and effective limit of a user after each answered request.

    A 429 lowers the factor; a success raises it if there was no 429 in the last five minutes and the
    factor is below 1; an hour without a change forgets it. The factor itself must be followed in
    order, but few requests move it: of 429s in a row only the first 7 can, and between two 429s only
    the first 70 successes after the calm time. Those are found with running values and followed per
    user; their number is bounded by the time span, not by the number of requests.
    """
    by_time = time_slice(F.col("ts"))
    answered = requests.where((F.col("status_code") == 429) | is_success()).select(
        "user_id", "ts", "request_id", (F.col("status_code") == 429).alias("hit"))
    at = F.unix_micros("ts")
    seen = running(answered, ["user_id"], _ORDER, by_time,
                   {"last_hit": Running("max", F.when(F.col("hit"), at), False)})
    calm = ~F.col("hit") & (at - F.col("last_hit") >= CALM_SECONDS * 1_000_000)
    seen = cut(seen.withColumn("calm", F.coalesce(calm, F.lit(False))), "answered")
    counted = running(seen, ["user_id"], _ORDER, by_time, {
        "hits": Running("sum", F.col("hit").cast("long")),
        "last_calm": Running("max", F.when(F.col("calm"), at), False)})
    fresh = F.col("hit") & (F.col("last_hit").isNull()
                            | (at - F.col("last_hit") >= MEMORY_SECONDS * 1_000_000)
                            | F.coalesce(F.col("last_calm") > F.col("last_hit"), F.lit(False)))
    counted = cut(counted.withColumn("fresh", fresh), "counted")
    hits = running(counted.where(F.col("hit")), ["user_id"], _ORDER, by_time, {
        "run_start": Running("max", F.when(F.col("fresh"), F.col("hits")))})
    moving_hits = hits.where(F.col("hits") - F.col("run_start") < STEPS_DOWN)
    moving_calm = numbered(counted.where(F.col("calm")), ["user_id", "hits"], _ORDER, by_time).where(
        F.col("position") <= STEPS_UP)
    move = F.struct(at.alias("at"), "request_id", "hit", F.coalesce("last_hit", F.lit(_ALWAYS)).alias("last_hit"))
    moves = (moving_hits.select("user_id", move.alias("m")).unionByName(moving_calm.select("user_id", move.alias("m")))
             .groupBy("user_id").agg(F.array_sort(F.collect_list("m")).alias("m")))
    followed = (moves.select("user_id", "m", _factor_udf("m.at", "m.hit", "m.last_hit").alias("f"))
                .select("user_id", F.explode(F.arrays_zip(
                    F.col("m.request_id").alias("request_id"), F.col("f.factor").alias("factor"),
                    F.col("f.changed").alias("changed"))).alias("z"))
                .select("user_id", "z.*").toDF("user_id", "request_id", "factor", "changed"))
    known = cut(seen.join(followed, ["user_id", "request_id"], "left"), "followed")
    state = running(known.select("user_id", "ts", "request_id", "hit", "factor", "changed"), ["user_id"], _ORDER,
                    by_time, {
        "state": Running("max", F.when(F.col("factor").isNotNull(),
                                       F.struct("ts", "request_id", "factor", "changed"))),
        "hit_at": Running("max", F.when(F.col("hit"), at))})
    changed = F.greatest("state.changed", "hit_at")
    alive = F.coalesce(at - changed < MEMORY_SECONDS * 1_000_000, F.lit(False))
    return state.select("user_id", "request_id", "ts",
                        F.when(alive, F.col("state.factor")).otherwise(1.0).alias("factor"),
                        F.when(alive, changed).alias("changed_at")).withColumn(
        "effective_limit", (F.col("factor") * base).cast("int"))


def user_throttle_stats(requests: DataFrame, as_of, base: int = REQUEST_LIMIT) -> DataFrame:
    """Per user at ``as_of`` (a timestamp column): 429s and successes counted since the last quiet
    hour, 429s of the last five minutes, factor and effective limit."""
    past = requests.where(F.col("ts") <= as_of)
    moment = F.unix_micros(as_of)
    memory = MEMORY_SECONDS * 1_000_000

    def counter(condition, name: str) -> DataFrame:
        rows = cut(gap_sessions(past.where(condition).select("user_id", "ts", "request_id"), ["user_id"],
                                MEMORY_SECONDS, _ORDER), name)
        sessions = rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
        return sessions.groupBy("user_id").agg(F.max_by(F.struct("n", "last"), "session").alias("s")).select(
            "user_id", F.when(moment - F.unix_micros("s.last") < memory, F.col("s.n")).otherwise(0).alias(name))

    recent = past.groupBy("user_id").agg(F.count_if(
        (F.col("status_code") == 429) & (F.unix_micros("ts") > moment - CALM_SECONDS * 1_000_000)).alias("recent_429s_5m"))
    last = adaptive_limits(past, base).groupBy("user_id").agg(
        F.max_by(F.struct("factor", "changed_at"), F.struct(*_ORDER)).alias("s"))
    factor = F.when(moment - F.col("s.changed_at") < memory, F.col("s.factor")).otherwise(1.0)
    return (recent.join(counter(F.col("status_code") == 429, "count_429_1h"), "user_id", "left")
            .join(counter(is_success(), "success_count_1h"), "user_id", "left")
            .join(last.select("user_id", factor.alias("adaptive_factor")), "user_id", "left")
            .select("user_id", F.lit(base).alias("base_limit"),
                    F.coalesce("adaptive_factor", F.lit(1.0)).alias("adaptive_factor"),
                    (F.coalesce("adaptive_factor", F.lit(1.0)) * base).cast("int").alias("effective_limit"),
                    F.coalesce("count_429_1h", F.lit(0)).alias("count_429_1h"),
                    F.coalesce("success_count_1h", F.lit(0)).alias("success_count_1h"), "recent_429s_5m"))
