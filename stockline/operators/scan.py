"""Running totals over ordered groups that may be far too large for one task.

A plain ``Window.partitionBy(key).orderBy(...)`` sends each key to one task. Here every group is
cut into *slices*, which must rise with the row order (an hour of event time, a range of sequence
numbers). Totals run inside each slice, the few slice totals of a key are accumulated, and the
result is carried back to the rows (a null key is a key like any other):

    rows --exchange(key, slice)--> totals inside the slice ---------------+
    rows --partial aggregate--> one row per (key, slice) --> carried in --+--> join --> result

The rows cross the network once, spread over (key, slice); a hot key costs one small row per slice.

Slices by a stretch of time may still be too large: all rows of a key may lie in one hour, or share one
timestamp. ``place`` counts the rows per key and slice and cuts those with more than ``SLICE_ROWS`` at
places of the whole order that split them evenly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockline.session import cut

SLICE = "_slice"
#: Rows of a key that may share a slice, and splitters that are compared at once.
SLICE_ROWS, SPLITTERS = 1_000_000, 32
#: Counters by which crowded slices are looked for first.
COUNTERS = 16384

_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max or min; ``inclusive`` counts the row itself."""

    kind: str
    value: Column
    inclusive: bool = True


def time_slice(ts: Column, seconds: int = 3600) -> Column:
    """The stretch of time a row is in; rows without a time are in one before all others."""
    return F.coalesce(F.floor(F.unix_seconds(ts) / F.lit(seconds)), F.lit(-(1 << 40)))


def number_slice(position: Column, width: int = 1_000_000) -> Column:
    return F.floor(position / F.lit(width))


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Join on columns of which null is a value like any other."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in columns})
    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in columns]
    joined = left.join(renamed, on or F.lit(True), how)
    return joined.drop(*[f"_of_{c}" for c in columns])


def crowded(rows: DataFrame, keys: Sequence[str], most: int | None = None) -> Column | None:
    """Which rows may belong to keys with more than ``most`` rows (default ``SLICE_ROWS``); null if no key has so many.
    Found by counts of some thousand hash values of the keys, which run at once; a few other keys are taken along."""
    spread = F.pmod(F.xxhash64(*keys), F.lit(COUNTERS))
    full = rows.groupBy(spread.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(
        F.col("_n") > (SLICE_ROWS if most is None else most))
    suspects = [row[0] for row in full.select("_h").collect()]  # at most COUNTERS numbers
    return spread.isin(suspects) if suspects else None


def place(rows: DataFrame, keys: Sequence[str], order: Sequence[str], slice_by: Column,
          most: int | None = None) -> DataFrame:
    """``rows`` with the slice each belongs to: ``slice_by``, and a part of it where a key has more than ``most``
    rows (default ``SLICE_ROWS``) there. Rows that have been placed stay where they are.

    Crowded slices are found by counts, which run at once: first by some thousand hash values of (key, slice), and only
    where one of these is too large by key and slice. Their rows are then dealt out by Spark's range partitioning over the
    whole order, whose sampled bounds split any group evenly; the first row of each share is a splitter, and the splitters
    are written once, so that every later reading cuts at the same places. Rows that are alike in the whole ``order``
    stay together. An expensive input should be written first.
    """
    if SLICE in rows.columns:
        return rows
    most = SLICE_ROWS if most is None else most
    coarse = rows.withColumn("_coarse", slice_by)
    group = [*keys, "_coarse"]
    spread = F.pmod(F.xxhash64(*group), F.lit(COUNTERS))
    full = coarse.groupBy(spread.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    suspects = [row[0] for row in full.select("_h").collect()]  # at most COUNTERS numbers
    crowded = (coarse.where(spread.isin(suspects)).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
               .where(F.col("_n") > most))
    total = crowded.agg(F.sum("_n")).first()[0] if suspects else None
    if not total:
        return coarse.withColumnRenamed("_coarse", SLICE)
    at = F.struct(*order)
    shares = (_same(coarse.select(*group, at.alias("_at")), crowded.drop("_n"), group, "left_semi")
              .repartitionByRange(max(2, -(-2 * total // most)), *group, "_at")
              .withColumn("_share", F.spark_partition_id()))
    firsts = shares.groupBy(*group, "_share").agg(F.min("_at").alias("_first"))
    ordered = F.array_sort(F.collect_list("_first"))
    nested = F.transform(F.sequence(F.lit(1), F.size("_all"), F.lit(SPLITTERS)), lambda k: F.slice("_all", k, SPLITTERS))
    splitters = cut(firsts.groupBy(*group).agg(ordered.alias("_all")).select(*group, nested.alias("_splitters")), "splitters")
    # The last group of splitters that begins at or before the row, and the place among them.
    outer = F.size(F.filter("_splitters", lambda s: F.element_at(s, 1) <= at))
    inner = F.size(F.filter(F.element_at("_splitters", F.greatest("_outer", F.lit(1))), lambda s: s <= at))
    part = F.coalesce((F.col("_outer") - 1) * SPLITTERS + inner, F.lit(0))
    return (_same(coarse, splitters, group, "left").withColumn("_outer", outer)
            .withColumn(SLICE, F.struct(F.col("_coarse").alias("coarse"), part.alias("part")))
            .drop("_coarse", "_outer", "_splitters"))


def _combine(kind: str, carried: Column, local: Column) -> Column:
    if kind == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(carried, local)


def running(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    slice_by: Column | None,
    values: Mapping[str, Running],
) -> DataFrame:
    """Add one running column per entry of ``values`` to ``rows``. Rows that have been placed keep their slices.

    ``slice_by`` is any column that never falls along ``order``; a struct of two such columns cuts
    finer, e.g. where very many rows of a key share one timestamp. ``rows`` is read twice, so an
    expensive input should be written first (``session.cut``).
    """
    sliced = rows if SLICE in rows.columns else rows.withColumn(SLICE, slice_by)
    group = [*keys, SLICE]
    inside = Window.partitionBy(*group).orderBy(*order)
    local = sliced.withColumns({
        name: _AGGREGATE[v.kind](v.value).over(
            inside.rowsBetween(Window.unboundedPreceding, 0 if v.inclusive else -1))
        for name, v in values.items()
    })
    totals = sliced.groupBy(*group).agg(
        *[_AGGREGATE[v.kind](v.value).alias(f"_total_{n}") for n, v in values.items()])
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*group, *[
        _AGGREGATE[v.kind](f"_total_{n}").over(before).alias(f"_carried_{n}")
        for n, v in values.items()
    ])
    renamed = carried.withColumnsRenamed({c: f"_of_{c}" for c in group})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in group]
    return local.join(renamed, same, "left").select(
        *[F.col(c) for c in rows.columns],
        *[_combine(v.kind, F.col(f"_carried_{n}"), F.col(n)).alias(n) for n, v in values.items()],
    )


def numbered(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    slice_by: Column | None = None,
    name: str = "position",
) -> DataFrame:
    """``row_number()`` for groups of any size."""
    return running(rows, keys, order, slice_by, {name: Running("sum", F.lit(1).cast("long"))})


def keep_one(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in ``order``. Spark cuts each task's rows to one per key before the
    shuffle, so it does not matter how many copies a key has."""
    ranked = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") == 1).drop("_rank")
