"""Metrics, request logs and health, aggregated from append-only event tables."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.operators.scan import Running, running, time_slice
from stockline.operators.sessions import event_stretches
from stockline.session import cut

# Upper bounds of the duration buckets, in seconds.
BUCKETS = {
    "http": [0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0],
    "db": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 2.5, 5.0],
    "task": [1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0, 1800.0],
    "api": [0.1, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 180.0],
    "sync": [1.0, 5.0, 10.0, 30.0, 60.0, 300.0, 600.0, 1800.0],
    "redis": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0],
}

# Labels of each counter.
COUNTER_LABELS = {
    "http_requests": ["method", "endpoint", "status_code"],
    "tasks": ["task_name", "status"],
    "api_requests": ["method", "endpoint", "status_code"],
    "rate_limit_hits": ["user_id"],
    "limiter_requests": ["user_id", "allowed"],
    "breaker_failures": ["service", "error_type"],
    "sync_operations": ["operation_type", "status"],
    "sync_items": ["operation_type", "action"],
    "store_operations": ["operation", "status"],
}

PERCENTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
#: Rows that selection may count up value by value in a task; quantiles from which it takes its next range, and their accuracy.
SELECT_ROWS, SELECT_POINTS, SELECT_ACCURACY = 1_000_000, 256, 10_000


def _mean(value: str) -> Column:
    return F.sum(value).cast("double") / F.count(value)


def counter_totals(metric_events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return metric_events.groupBy("name", *labels).agg(F.sum("value").alias("total"))


def last_n_values(metric_events: DataFrame, labels: Sequence[str], n: int, shares: int = 64) -> DataFrame:
    """The newest ``n`` values per key.

    A tree of three levels, as a key may be everywhere: every task keeps at most ``n`` of its rows per key, ``shares``
    groups per key keep at most ``n`` of those, and the last group gets at most ``n * shares`` rows, however many tasks
    there were.
    """
    latest = [F.col("ts").desc(), F.col("seq").desc()]
    share = F.pmod(F.xxhash64("ts", "seq"), F.lit(shares))
    few = (metric_events.withColumn("_share", share)
           .withColumn("_rank", F.row_number().over(Window.partitionBy("name", *labels, "_share").orderBy(*latest)))
           .where(F.col("_rank") <= n).drop("_share"))
    return (few.withColumn("_rank", F.row_number().over(Window.partitionBy("name", *labels).orderBy(*latest)))
            .where(F.col("_rank") <= n).drop("_rank"))


def histogram_stats(metric_events: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Count, least, greatest and mean of all values per key."""
    return metric_events.groupBy("name", *labels).agg(
        F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        _mean("value").alias("avg"))


def bucket_histogram(events: DataFrame, buckets: Sequence[float], labels: Sequence[str],
                     value: str = "value") -> DataFrame:
    """Cumulative counts per upper bound ``le`` (as text, '+Inf' last) with count and sum, in one pass."""
    bounds = [*[str(float(b)) for b in buckets], "+Inf"]
    counts = [F.count_if(F.col(value) <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    wide = events.groupBy(*labels).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))
    pairs = F.array(*[
        F.struct(F.lit(bound).alias("le"),
                 (F.col(f"_b{i}") if i < len(buckets) else F.col("count")).alias("bucket"))
        for i, bound in enumerate(bounds)])
    return wide.select(*labels, "count", "sum", F.inline(pairs))


def gauge_latest(metric_events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return metric_events.groupBy("name", *labels).agg(
        F.max_by("value", F.struct("ts", "seq")).alias("value"))


def labelled_counts(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("total"))


def health_rollup(component_status: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Overall status per group of components (column ``status``)."""
    status = F.coalesce(F.col("status"), F.lit("unknown"))
    return component_status.groupBy(*keys).agg(
        F.when(F.bool_and(status == "healthy"), "healthy")
        .when(F.bool_or(status == "unhealthy"), "unhealthy").otherwise("degraded").alias("status"))


def is_success() -> Column:
    code = F.col("status_code")
    return F.coalesce((code >= 200) & (code < 300), F.lit(False))


def failure_type() -> Column:
    """api_error, network_error, or null. A request without a status never got an answer; any answer
    but success is an error, except that a 429 is no failure."""
    code = F.col("status_code")
    return F.when(code.isNull(), "network_error").when(~is_success() & (code != 429), "api_error")


def failure_types(requests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (requests.withColumn("error_type", failure_type()).where(F.col("error_type").isNotNull())
            .groupBy(*keys, "error_type").agg(F.count(F.lit(1)).alias("failures")))


def recent_throttles(requests: DataFrame, window_seconds: int = 300) -> DataFrame:
    """Per request, the user's 429s in the last ``window_seconds`` (the far end excluded).

    Time is cut into stretches of one window, and a group is one user's stretch. A 429 counts one from
    its time on and minus one a window later, in its own stretch and the next one, so the number is a
    running sum over rows that are read once.
    """
    width = window_seconds * 1_000_000
    at = F.unix_micros("ts")
    stretch = F.floor(at / F.lit(width))
    hit = F.coalesce(F.col("status_code") == 429, F.lit(False))

    def step(where: Column, when: Column, change: int, own: bool) -> Column:
        return F.struct(where.alias("stretch"), when.alias("at"), F.lit(change).alias("change"), F.lit(own).alias("own"))

    steps = F.when(hit, F.array(step(stretch, at, 1, True), step(stretch + 1, at, 1, False),
                                step(stretch + 1, at + width, -1, False))).otherwise(F.array(step(stretch, at, 0, True)))
    placed = requests.select("*", F.explode(steps).alias("_step"))
    before = (Window.partitionBy("user_id", "_step.stretch").orderBy("_step.at")
              .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return (placed.withColumn("recent_429s", F.sum("_step.change").over(before))
            .where(F.col("_step.own")).select(*requests.columns, "recent_429s"))


def gap_sessions(events: DataFrame, keys: Sequence[str], gap_seconds: int, order: Sequence[str]) -> DataFrame:
    """Rows with ``ordinal`` (1, 2, ... per key) and ``session`` (1, 2, ... per key): an event at least
    ``gap_seconds`` after the one before it starts a new session."""
    by_time = time_slice(F.col("ts"))
    seen = running(events, keys, order, by_time, {"_before": Running("max", F.col("ts"), False)})
    gap = F.unix_micros("ts") - F.unix_micros("_before")
    starts = F.col("_before").isNull() | (gap >= gap_seconds * 1_000_000)
    return running(seen.withColumn("_start", starts.cast("long")), keys, order, by_time, {
        "ordinal": Running("sum", F.lit(1).cast("long")), "session": Running("sum", F.col("_start")),
    }).drop("_before", "_start")


def outage_sessions(requests: DataFrame, keys: Sequence[str] = (), gap_seconds: int = 60,
                    threshold: int = 5) -> DataFrame:
    """Stretches of failures, each less than ``gap_seconds`` after the last, that reach the threshold;
    the circuit opens at the failure that does. Failures without a time belong to no stretch."""
    failures = requests.where(failure_type().isNotNull()).select(*keys, "ts", "request_id")
    return opened_outages(event_stretches(failures, keys, gap_seconds, ["ts", "request_id"], threshold), keys, threshold)


def opened_outages(stretches: DataFrame, keys: Sequence[str], threshold: int) -> DataFrame:
    """The stretches of failures that reach the threshold."""
    return stretches.where(F.col("events") >= threshold).select(
        *keys, "started_at", F.element_at("firsts", threshold).alias("opened_at"), "ended_at",
        F.col("events").alias("failures"))


def exact_percentiles(rows: DataFrame, keys: Sequence[str], value: str,
                      percentiles: Mapping[str, float] = PERCENTILES, few: int = SELECT_ROWS) -> DataFrame:
    """Nearest-rank percentiles per key, exact at any size and for any distribution.

    Each wanted rank keeps a range of values that holds it, at first all values of the key. As long as a range has more
    than ``few`` rows, a round takes two values near the rank from approximate quantiles of the range, counts the rows
    below, at, between and above them, and goes on with the part that holds the rank: usually what lies between, a small
    share of the rows, or one of the two values itself. Then the distinct values that are left are counted up. So no task
    gets more than ``few`` values of a range, however alike they are, and the counts decide, not the approximation. NaN is
    no value.
    """
    number = F.col(value).cast("double")
    known = rows.where(number.isNotNull() & ~F.isnan(number)).select(*keys, number.alias("_value"))
    names = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(share).alias("share")) for name, share in percentiles.items()])
    whole = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_value").alias("_low"), F.max("_value").alias("_high"))
    goals = cut(whole.select("*", F.explode(names).alias("_goal")).select(
        *keys, F.col("_goal.name").alias("_name"), F.ceil(F.col("_n") * F.col("_goal.share")).alias("_rank"), "_n", "_low",
        "_high"), "ranks")
    settled = F.col("_low") == F.col("_high")
    done = []
    while True:
        done.append(goals.where(settled))
        done.append(_counted_up(known, keys, goals.where(~settled & (F.col("_n") <= few))))
        left = goals.where(~settled & (F.col("_n") > few))
        if left.isEmpty():
            break
        goals = cut(_narrowed(known, keys, left), "ranks")
    found = functools.reduce(DataFrame.unionByName, done)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in percentiles])


def _inside(known: DataFrame, keys: Sequence[str], ranges: DataFrame) -> DataFrame:
    """The values inside some ranges of their key."""
    named = ranges.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    joined = known.join(named, [*same, F.col("_value").between(F.col("_low"), F.col("_high"))])
    return joined.drop(*[f"_of_{k}" for k in keys])


def _counted_up(known: DataFrame, keys: Sequence[str], goals: DataFrame) -> DataFrame:
    """Goals with few rows: the value at their rank."""
    group = [*keys, "_low", "_high"]
    counts = _inside(known, keys, goals.select(*group).distinct()).groupBy(*group, "_value").agg(F.count(F.lit(1)).alias("_in"))
    upto = F.sum("_in").over(Window.partitionBy(*group).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_upto", upto).withColumnsRenamed({c: f"_of_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    holds = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_in") < F.col("_rank"))
    return goals.join(placed, [*same, holds]).select(
        *keys, "_name", F.lit(1).cast("long").alias("_rank"), F.col("_in").alias("_n"), F.col("_value").alias("_low"),
        F.col("_value").alias("_high"))


def _narrowed(known: DataFrame, keys: Sequence[str], goals: DataFrame) -> DataFrame:
    """Goals with the part of their range that holds their rank."""
    group = [*keys, "_low", "_high"]
    shares = [k / SELECT_POINTS for k in range(SELECT_POINTS + 1)]
    points = (_inside(known, keys, goals.select(*group).distinct()).groupBy(*group)
              .agg(F.percentile_approx("_value", shares, SELECT_ACCURACY).alias("_points")))
    renamed = points.withColumnsRenamed({c: f"_of_{c}" for c in group})
    at = F.floor(F.col("_rank") / F.col("_n") * SELECT_POINTS).cast("int")
    lower = F.when(at <= 1, F.col("_low")).otherwise(F.get("_points", at - 1))
    upper = F.when(at >= SELECT_POINTS - 2, F.col("_high")).otherwise(F.get("_points", at + 2))
    marked = (goals.join(renamed, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group])
              .select(*goals.columns, lower.alias("_from"), F.greatest(lower, upper).alias("_to")))
    v, low, high = F.col("_value"), F.col("_from"), F.col("_to")
    parts = [v < low, v == low, (v > low) & (v < high), (v == high) & (high > low), v > high]
    counted = _inside(known, keys, marked).groupBy(*keys, *[c for c in marked.columns if c not in keys]).agg(*[
        x for k, part in enumerate(parts) for x in (
            F.count_if(part).alias(f"_n{k}"), F.min(F.when(part, v)).alias(f"_least{k}"), F.max(F.when(part, v)).alias(f"_most{k}"))])
    before, chosen = F.lit(0), None
    for k in range(len(parts)):
        here = F.struct((F.col("_rank") - before).alias("rank"), F.col(f"_n{k}").alias("n"), F.col(f"_least{k}").alias("low"),
                        F.col(f"_most{k}").alias("high"))
        before = before + F.col(f"_n{k}")
        holds = F.col("_rank") <= before
        chosen = F.when(holds, here) if chosen is None else chosen.when(holds, here)
    return counted.withColumn("_part", chosen).select(
        *keys, "_name", F.col("_part.rank").alias("_rank"), F.col("_part.n").alias("_n"), F.col("_part.low").alias("_low"),
        F.col("_part.high").alias("_high"))


def latency_report(requests: DataFrame) -> DataFrame:
    """Per endpoint: requests, rate per second, percentiles, error shares and active users."""
    code = F.col("status_code")
    n = F.count(F.lit(1))
    seconds = F.greatest(F.lit(1), F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts")))
    base = requests.groupBy("endpoint").agg(
        n.alias("requests"), (n.cast("double") / seconds).alias("rate"),
        (F.count_if((code >= 400) & (code < 500)).cast("double") / n).alias("share_4xx"),
        (F.count_if(code >= 500).cast("double") / n).alias("share_5xx"),
        F.count_if(code == 429).alias("throttled"), F.count_distinct("user_id").alias("active_users"))
    return base.join(exact_percentiles(requests, ["endpoint"], "duration_s"), "endpoint", "left")


