"""Stretches of events, each less than a gap after the one before, for keys of any size.

A stretch is summed up as (first, last, count, its first few times). Summaries of one key that lie less than a gap apart, or
overlap, merge: counts add up, and the first few times are the least of both. So a key's time is cut into slices, every
slice finds its own stretches, and only those that may go on in another slice, the first and last of each slice, meet:

    rows --exchange(key, slice)--> stretches inside the slice --+--> inner ones: done
                                                                +--> open ends --exchange(key)--> joined across slices

Rows without a time belong to no stretch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.operators.scan import SLICE, place, time_slice

SUMMARY = ["started_at", "ended_at", "events", "firsts"]


def _apart(earlier: Column, later: Column, gap_seconds: int) -> Column:
    return F.coalesce(F.unix_micros(later) - F.unix_micros(earlier) >= gap_seconds * 1_000_000, F.lit(True))


def _numbered(rows: DataFrame, group: Sequence[str], start: str, end: str, order: Sequence[str], gap_seconds: int) -> DataFrame:
    """Number the stretches inside each group in ``_stretch``."""
    inside = Window.partitionBy(*group).orderBy(*order)
    reached = F.max(end).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("_starts", _apart(reached, F.col(start), gap_seconds).cast("long"))
            .withColumn("_stretch", F.sum("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts"))


def _least(lists: Column, n: int) -> Column:
    return F.slice(F.array_sort(F.flatten(lists)), 1, n)


def merge_summaries(summaries: DataFrame, group: Sequence[str], gap_seconds: int, firsts: int) -> DataFrame:
    """Summaries (in any order, overlapping or not) as the stretches they form inside each group. A group should be a
    bounded stretch of a key's time. Of a stretch's first times no more than ``firsts`` are brought together: a
    summary that begins after that many events adds none."""
    numbered = _numbered(summaries, group, "started_at", "ended_at", ["started_at", "ended_at"], gap_seconds)
    # Events in summaries that end before this one starts come before all of this one's.
    before = (Window.partitionBy(*group, "_stretch").orderBy(F.unix_micros("ended_at"))
              .rowsBetween(Window.unboundedPreceding, -1))
    needed = F.coalesce(F.sum("events").over(before), F.lit(0)) < firsts
    overlapping = F.max("ended_at").over(before) >= F.col("started_at")
    kept = F.when(needed | F.coalesce(overlapping, F.lit(False)), F.col("firsts")).otherwise(F.array().cast("array<timestamp>"))
    return (numbered.withColumn("firsts", kept).groupBy(*group, "_stretch")
            .agg(F.min("started_at").alias("started_at"), F.max("ended_at").alias("ended_at"),
                 F.sum("events").alias("events"), _least(F.collect_list("firsts"), firsts).alias("firsts"))
            .drop("_stretch"))


def local_stretches(events: DataFrame, keys: Sequence[str], gap_seconds: int, order: Sequence[str], firsts: int,
                    slice_by: Column | None = None) -> DataFrame:
    """The stretches inside each (key, slice), and whether one may go on outside: ``open``."""
    placed = place(events.where(F.col("ts").isNotNull()), keys, order,
                   time_slice(F.col("ts")) if slice_by is None else slice_by)
    group = [*keys, SLICE]
    rows = _numbered(placed, group, "ts", "ts", order, gap_seconds)
    nth = F.row_number().over(Window.partitionBy(*group, "_stretch").orderBy(*order))
    last = F.max("_stretch").over(Window.partitionBy(*group))
    return (rows.withColumns({"_nth": nth, "_last": last}).groupBy(*group, "_stretch")
            .agg(F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("events"),
                 F.array_sort(F.collect_list(F.when(F.col("_nth") <= firsts, F.col("ts")))).alias("firsts"),
                 F.max("_last").alias("_last"))
            .withColumn("open", (F.col("_stretch") == 1) | (F.col("_stretch") == F.col("_last"))).drop("_stretch", "_last"))


def join_open(local: DataFrame, keys: Sequence[str], gap_seconds: int, firsts: int) -> DataFrame:
    """Stretches of slices as whole stretches: open ends of a key that meet become one."""
    joined = merge_summaries(local.where("open").select(*keys, *SUMMARY), keys, gap_seconds, firsts)
    return local.where("not open").select(*keys, *SUMMARY).unionByName(joined.select(*keys, *SUMMARY))


def event_stretches(events: DataFrame, keys: Sequence[str], gap_seconds: int, order: Sequence[str],
                    firsts: int = 1) -> DataFrame:
    """All stretches of a table: keys, started_at, ended_at, events, and the first ``firsts`` times."""
    return join_open(local_stretches(events, keys, gap_seconds, order, firsts), keys, gap_seconds, firsts)
