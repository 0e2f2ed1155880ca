"""Continuous alerts, outages, rate limits and counters.

Alerts, counters and outages are *reports*: mergeable aggregates of a day's rows. ``batch`` makes one of a table;
``run_report`` keeps one of a stream, day by day (see ``day_table``), so that rows of any age count and correct what has
been given out. Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from stockline.operators.scan import time_slice
from stockline.operators.sessions import SUMMARY, join_open, local_stretches, merge_summaries
from stockline.operators.telemetry import failure_type, opened_outages
from stockline.operators.throttle import REQUEST_LIMIT, WINDOW_SECONDS
from stockline.streaming.day_table import DAY, DayTable, day_of

# Alert thresholds.
MAX_ERROR_RATE = 0.01
MAX_THROTTLES = 10
MAX_QUEUE_DEPTH = 1000
MAX_POOL_USE = 0.8


@dataclass(frozen=True)
class Report:
    """How rows become aggregates by ``keys`` and ``day``, how aggregates of the same rows' days merge, and what is shown.

    ``partial`` and ``merge`` give ``keys``, ``day`` and measures; merging must not depend on how the rows were dealt to
    partials. ``shown`` works on the merged aggregates of all days; ``judged`` on those of some keys and days.
    """

    keys: Sequence[str]
    partial: Callable[[DataFrame], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    judged: Callable[[DataFrame], DataFrame]
    shown: Callable[[DataFrame], DataFrame]

    def batch(self, rows: DataFrame) -> DataFrame:
        return self.shown(self.partial(rows))


def _window(size: str, slide: str | None) -> Column:
    return F.window("ts", size, slide) if slide else F.window("ts", size)


def _windowed(keys: Sequence[str], grouped: Callable[[DataFrame], DataFrame], measures: dict[str, Callable],
              judged: Callable[[DataFrame], DataFrame], passes: Column | None = None) -> Report:
    """A report by windows of time: ``measures`` names each measure and the aggregate that merges it."""
    def merge(parts: DataFrame) -> DataFrame:
        return parts.groupBy(*keys, DAY).agg(*[of(name).alias(name) for name, of in measures.items()])

    def partial(rows: DataFrame) -> DataFrame:
        return grouped(rows.where(F.col("ts").isNotNull())).withColumn(DAY, day_of(F.col("window_start")))

    def shown(merged: DataFrame) -> DataFrame:
        found = judged(merged.drop(DAY))
        return found if passes is None else found.where(passes)

    return Report(keys, partial, merge, lambda merged: judged(merged.drop(DAY)), shown)


def alert_report(size: str = "5 minutes", slide: str | None = None, max_error_rate: float = MAX_ERROR_RATE,
                 max_throttles: int = MAX_THROTTLES) -> Report:
    """Windows in which 5xx answers or 429s pass their threshold."""
    code = F.col("status_code")

    def grouped(requests: DataFrame) -> DataFrame:
        return (requests.groupBy(_window(size, slide).alias("w")).agg(
            F.count(F.lit(1)).alias("requests"), F.count_if(code >= 500).alias("errors"),
            F.count_if(code == 429).alias("throttles"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "requests", "errors",
                    "throttles"))

    def judged(counted: DataFrame) -> DataFrame:
        rate = F.col("errors").cast("double") / F.col("requests")
        return counted.select("window_start", "window_end", "requests", "errors", "throttles",
                              (rate > max_error_rate).alias("error_alert"),
                              (F.col("throttles") > max_throttles).alias("throttle_alert"))

    return _windowed(["window_start", "window_end"], grouped, dict.fromkeys(["requests", "errors", "throttles"], F.sum),
                     judged, F.col("error_alert") | F.col("throttle_alert"))


def gauge_report(limits: dict[str, float], size: str = "5 minutes") -> Report:
    """Windows in which a gauge (name, value, ts) passes its limit, e.g. queue depth or pool use."""
    limit = F.create_map(*[F.lit(x) for name, bound in limits.items() for x in (name, float(bound))])

    def grouped(gauges: DataFrame) -> DataFrame:
        return (gauges.where(F.col("name").isin(list(limits))).groupBy("name", _window(size, None).alias("w"))
                .agg(F.max("value").alias("peak")).select("name", F.col("w.start").alias("window_start"), "peak"))

    return _windowed(["name", "window_start"], grouped, {"peak": F.max}, lambda rows: rows.select("name", "window_start", "peak"),
                     F.col("peak") > F.element_at(limit, F.col("name")))


def sync_report(size: str = "1 minute") -> Report:
    """Items per window, operation type and action (outcomes with ts, operation_type, outcome)."""
    action = F.when(F.col("outcome").startswith("skip"), "skipped").otherwise(F.col("outcome"))

    def grouped(outcomes: DataFrame) -> DataFrame:
        return (outcomes.groupBy(_window(size, None).alias("w"), "operation_type", action.alias("action"))
                .agg(F.count(F.lit(1)).alias("total"))
                .select(F.col("w.start").alias("window_start"), "operation_type", "action", "total"))

    keys = ["window_start", "operation_type", "action"]
    return _windowed(keys, grouped, {"total": F.sum}, lambda rows: rows.select(*keys, "total"))


def outage_report(keys: Sequence[str], gap_seconds: int = 60, threshold: int = 5) -> Report:
    """Stretches of failures per key that reach the threshold (see ``operators.sessions``). A day holds the stretches of
    its own rows; where they go on over midnight they are joined when shown."""
    group = [*keys, DAY]

    def partial(requests: DataFrame) -> DataFrame:
        failures = requests.where(failure_type().isNotNull()).select(
            *keys, "ts", "request_id", day_of(F.col("ts")).alias(DAY))
        local = local_stretches(failures, group, gap_seconds, ["ts", "request_id"], threshold, time_slice(F.col("ts")))
        return join_open(local, group, gap_seconds, threshold).select(*group, *SUMMARY)

    def merge(parts: DataFrame) -> DataFrame:
        return merge_summaries(parts, group, gap_seconds, threshold).select(*group, *SUMMARY)

    def shown(merged: DataFrame) -> DataFrame:
        first, last = F.min("started_at"), F.max("started_at")
        ends = Window.partitionBy(*group)
        opened = merged.withColumn("open", (F.col("started_at") == first.over(ends)) | (F.col("started_at") == last.over(ends)))
        return opened_outages(join_open(opened, keys, gap_seconds, threshold), keys, threshold)

    return Report(group, partial, merge, shown, shown)


def run_report(stream: DataFrame, report: Report, path: str, checkpoint: str, trigger: dict | None = None):
    """Keep a report of a stream; returns the running query.

    Each trigger changes the days its rows fall into, however long ago, and writes to ``path/updates/batch=<n>`` what is
    now known of the keys it touched (all of them, also those that pass no threshold any more); ``revised`` marks keys of
    which something had been given out before. ``report_rows`` reads the report as it is.
    """
    table = DayTable(f"{path}/days", _schema(stream, report))

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        part = report.partial(batch).persist()
        days = [row[0] for row in part.select(DAY).distinct().collect()]
        if days:
            table.tidy(session, days, batch_id)
            kept = table.read(session, days, batch_id)
            table.write(report.merge(kept.unionByName(part)), batch_id)
            touched = part.select(*report.keys).distinct()
            known = kept.select(*report.keys).distinct().withColumn("revised", F.lit(True))
            keys = [k for k in report.keys if k != DAY]
            flagged = touched.join(known, list(report.keys), "left").groupBy(*keys).agg(
                F.coalesce(F.max("revised"), F.lit(False)).alias("revised"))
            now = table.read(session, days, batch_id + 1).join(touched, list(report.keys), "left_semi")
            (report.judged(now).join(flagged, keys).write.mode("overwrite").parquet(f"{path}/updates/batch={batch_id}"))
        part.unpersist()

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def _schema(rows: DataFrame, report: Report) -> str:
    """Columns of the report's aggregates, as DDL."""
    empty = rows.sparkSession.createDataFrame([], rows.schema)
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in report.partial(empty).schema.fields)


def report_rows(spark: SparkSession, rows_schema, report: Report, path: str) -> DataFrame:
    """What a stream's report holds now (``rows_schema``: schema of the stream)."""
    empty = spark.createDataFrame([], rows_schema)
    return report.shown(DayTable(f"{path}/days", _schema(empty, report)).latest(spark))


def alert_windows(requests: DataFrame, size: str = "5 minutes", slide: str | None = None,
                  max_error_rate: float = MAX_ERROR_RATE, max_throttles: int = MAX_THROTTLES) -> DataFrame:
    return alert_report(size, slide, max_error_rate, max_throttles).batch(requests)


def gauge_alerts(gauges: DataFrame, limits: dict[str, float], size: str = "5 minutes") -> DataFrame:
    return gauge_report(limits, size).batch(gauges)


def sync_metrics(outcomes: DataFrame, size: str = "1 minute") -> DataFrame:
    return sync_report(size).batch(outcomes)


def outage_windows(requests: DataFrame, keys: Sequence[str], gap_seconds: int = 60, threshold: int = 5) -> DataFrame:
    return outage_report(keys, gap_seconds, threshold).batch(requests)


class BucketProcessor(StatefulProcessor):
    """Token bucket of one user: start of the open bucket and tokens used."""

    def __init__(self, limit: int, window: int) -> None:
        self.limit, self.window = limit, window

    def init(self, handle) -> None:
        self.bucket = handle.getValueState("bucket", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        log = pd.concat(list(rows)).sort_values(["at", "request_id"], kind="stable")
        times = log["at"].to_numpy()
        start, used = self.bucket.get() if self.bucket.exists() else (None, 0)
        starts, turn = np.empty(len(times), dtype="int64"), np.empty(len(times), dtype="int64")
        position = 0
        while position < len(times):
            if start is None or times[position] >= start + self.window:
                start, used = int(times[position]), 0
            end = max(position + 1, int(np.searchsorted(times, start + self.window, side="left")))
            starts[position:end] = start
            turn[position:end] = used + 1 + np.arange(end - position)
            used, position = used + end - position, end
        self.bucket.update((start, int(used)))
        allowed = turn <= self.limit
        yield pd.DataFrame({
            "user_id": log["user_id"], "request_id": log["request_id"], "allowed": allowed,
            "wait_seconds": np.where(allowed, np.nan, (starts + self.window - times) / 1e6)})

    def close(self) -> None:
        pass


def stream_throttle_audit(requests: DataFrame, limit: int = REQUEST_LIMIT,
                          window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Continuous form of throttle_audit; requests of a user must arrive in order of time."""
    user_type = requests.schema["user_id"].dataType.simpleString()
    id_type = requests.schema["request_id"].dataType.simpleString()
    slim = requests.select("user_id", "request_id", F.unix_micros("ts").alias("at"))
    return slim.groupBy("user_id").transformWithStateInPandas(
        BucketProcessor(limit, window_seconds * 1_000_000),
        f"user_id {user_type}, request_id {id_type}, allowed boolean, wait_seconds double", "Append", "None"
    ).withColumn("wait_seconds", F.when(~F.col("allowed"), F.col("wait_seconds")))
