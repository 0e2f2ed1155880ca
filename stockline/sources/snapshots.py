"""The inventory as versions of seller buckets.

Rows are dealt to a fixed number of buckets by the hash of their seller. A version is one small file that names, for
every bucket, the folder that holds it: a job writes the buckets of the sellers it touches to a folder of its own and
names a version in which only those have moved, so all other buckets keep their files. A large seller's bucket is
written as several files.

Versions are named one after another, and the file system lets each name be taken once. A job that finds its version
taken looks whether any of *its* buckets has moved since it read them. If not, its buckets are put on top of the newest
version; if so, ``VersionTaken`` is raised and the job is to be run again. So jobs on sellers of different buckets never
wait for each other, and no change is lost. Item ids are given out in ranges that are taken in the same way.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline import schemas
from stockline.sources import files

BUCKETS = 256
BUCKET = "_bucket"
SLICE = "_slice"
#: Rows of a bucket that lie together where a job places rows itself, and rows of one of its tasks.
SLICE_ROWS, TASK_ROWS = 100_000, 200_000
#: Versions that may be named by others while a job tries to name its own.
RACES = 1000


class VersionTaken(RuntimeError):
    """Another job has changed the same sellers, or written this version; run again from the newest one."""


@dataclass(frozen=True)
class Snapshot:
    """A version: for every bucket that has rows, the folder (under the inventory's path) that holds it."""

    version: int
    owner: str
    buckets: int
    last_id: int
    folders: dict[int, str]

    def bucket(self) -> Column:
        return bucket_of(self.buckets)


def bucket_of(buckets: int) -> Column:
    """The bucket of a row's seller; rows without a seller are in one, too."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("user_id").cast("string"), F.lit(""))), F.lit(buckets)).cast("int")


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in files.names(spark, f"{path}/versions") if n.endswith(".json"))


def _record(spark: SparkSession, path: str, version: int) -> Snapshot | None:
    """A version, or null if its file is not there or was never finished."""
    name = f"{path}/versions/{version}.json"
    try:
        found = json.loads(files.read_text(spark, name)) if files.exists(spark, name) else None
    except (json.JSONDecodeError, TypeError):
        return None
    return found and Snapshot(**{**found, "folders": {int(b): f for b, f in found["folders"].items()}})


def newest(spark: SparkSession, path: str) -> Snapshot | None:
    """The newest complete version."""
    found = (_record(spark, path, v) for v in reversed(_versions(spark, path)))
    return next((record for record in found if record), None)


def snapshot(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    found = newest(spark, path) if version is None else _record(spark, path, version)
    if found is None:
        raise ValueError(f"{path}: no version {'' if version is None else version}")
    return found


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest complete version."""
    found = newest(spark, path)
    return found and found.version


def last_id(spark: SparkSession, path: str) -> int:
    """The highest item id that any version has held or any job has taken."""
    found = newest(spark, path)
    taken = [int(n[:-5]) for n in files.names(spark, f"{path}/ids") if n.endswith(".json")]
    end = json.loads(files.read_text(spark, f"{path}/ids/{max(taken)}.json"))["end"] if taken else 0
    return max(found.last_id if found else 0, end)


def take_ids(spark: SparkSession, path: str, n: int) -> int:
    """The first of ``n`` item ids that nobody else gets."""
    for _ in range(RACES):
        start = last_id(spark, path) + 1
        if files.create(spark, f"{path}/ids/{start}.json", json.dumps({"end": start + n - 1})):
            return start
    raise VersionTaken(f"{path}: ids")


def touched_buckets(base: Snapshot, *frames: DataFrame) -> list[int]:
    """The buckets of the sellers (user_id) of some tables: at most as many as there are buckets."""
    found: set[int] = set()
    for frame in frames:
        found |= {row[0] for row in frame.select(base.bucket().alias(BUCKET)).distinct().collect()}
    return sorted(found)


def read_buckets(spark: SparkSession, path: str, base: Snapshot, schema: str,
                 buckets: Iterable[int] | None = None) -> DataFrame:
    """The rows of a version, or of some of its buckets: no other bucket's files are opened."""
    wanted = base.folders if buckets is None else {b: base.folders[b] for b in buckets if b in base.folders}
    paths = [f"{path}/{folder}/{BUCKET}={b}" for b, folder in sorted(wanted.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str, schema: str, version: int | None = None,
                  buckets: Iterable[int] | None = None) -> DataFrame:
    return read_buckets(spark, path, snapshot(spark, path, version), schema, buckets)


def placing(base: Snapshot, *frames: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """How to bring rows (id, user_id) of as many as are in ``frames`` to the tasks that write their buckets.

    Columns ``BUCKET`` and ``SLICE`` are added. A bucket is cut by item id into slices, so that a large seller is
    written by several tasks; tasks grow in number with the rows. Rows without an id are dealt by all they hold.
    """
    spark, rows = frames[0].sparkSession, {}
    for frame in frames:  # at most as many counts as there are buckets
        for bucket, n in frame.groupBy(base.bucket().alias(BUCKET)).count().collect():
            rows[bucket] = rows.get(bucket, 0) + n
    slices = spark.createDataFrame([(b, -(-n // SLICE_ROWS)) for b, n in sorted(rows.items())], f"{BUCKET} int, _slices int")
    tasks = max(1, -(-sum(rows.values()) // TASK_ROWS))

    def place(frame: DataFrame) -> DataFrame:
        plain = [F.col(n) for n, kind in frame.dtypes if n != "id" and not kind.startswith(("struct", "map"))]
        number = F.coalesce(F.xxhash64(F.col("id")), F.lit(0))
        dealt = F.when(F.col("id").isNull(), F.xxhash64(*plain)).otherwise(number)
        return (frame.withColumn(BUCKET, base.bucket()).join(F.broadcast(slices), BUCKET, "left")
                .withColumn(SLICE, F.pmod(dealt, F.coalesce("_slices", F.lit(1)))).drop("_slices")
                .repartition(tasks, BUCKET, SLICE))
    return place


def _write(inventory: DataFrame, path: str, folder: str, buckets: int, placed: bool = False,
           notes: Sequence[str] = ()) -> tuple[dict[int, str], int]:
    """Write rows in the stored schema, and the columns ``notes`` beside it; returns the buckets that have rows and the
    highest item id. ``placed`` rows (``placing``) are written by the tasks that have them."""
    spark = inventory.sparkSession
    stored = spark.createDataFrame([], schemas.INVENTORY).schema
    kept = [F.col(f.name).cast(f.dataType).alias(f.name) for f in stored.fields] + [F.col(n) for n in notes]
    # Rebalanced, so that a large seller is written by several tasks and small ones share a task.
    dealt = (inventory.select(*kept, BUCKET) if placed else
             inventory.select(*kept).withColumn(BUCKET, bucket_of(buckets)).hint("rebalance", F.col(BUCKET)))
    dealt.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{path}/{folder}")
    there = [int(n.split("=")[1]) for n in files.names(spark, f"{path}/{folder}") if n.startswith(f"{BUCKET}=")]
    paths = [f"{path}/{folder}/{BUCKET}={b}" for b in there]
    largest = spark.read.schema("id long").parquet(*paths).agg(F.max("id")).first()[0] if paths else None
    return {b: folder for b in there}, largest or 0


def _text(record: Snapshot) -> str:
    return json.dumps(asdict(record))


def write_inventory(inventory: DataFrame, path: str, version: int, owner: str = "", buckets: int = BUCKETS) -> None:
    """Write all buckets as a new version.

    Readers see it only when it is complete. The first to name a version has it: an owner that repeats its call
    overwrites its own data, any other owner gets ``VersionTaken`` and changes nothing. The version also keeps the highest
    item id ever given, so that ids of deleted items are not given again.
    """
    spark = inventory.sparkSession
    base, there = newest(spark, path), _record(spark, path, version)
    if there and there.owner != owner:
        raise VersionTaken(f"{path}: version {version}")
    buckets = base.buckets if base else buckets
    folders, largest = _write(inventory, path, f"data/{version}" + (f"-{owner}" if owner else ""), buckets)
    record = Snapshot(version, owner, buckets, max(largest, last_id(spark, path)), folders)
    name = f"{path}/versions/{version}.json"
    if not files.create(spark, name, _text(record)):
        there = _record(spark, path, version)
        if there is None or there.owner != owner:
            raise VersionTaken(f"{path}: version {version}")
        files.overwrite(spark, name, _text(record))


@dataclass(frozen=True)
class Written:
    """Buckets that are written and belong to no version yet."""

    path: str
    base: Snapshot
    touched: Sequence[int]
    owner: str
    folders: dict[int, str]
    largest: int

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        return read_buckets(spark, self.path, replace(self.base, folders=self.folders), schema)


def write_buckets(rows: DataFrame, path: str, base: Snapshot, touched: Sequence[int], owner: str = "",
                  placed: bool = False, notes: Sequence[str] = ()) -> Written:
    """Write ``rows``, all rows of the ``touched`` buckets. Nobody sees them before ``name_version``. Columns ``notes``
    are stored beside the schema for the job itself; readers of versions pass over them."""
    owner = owner or uuid.uuid4().hex
    folders, largest = _write(rows, path, f"data/{base.version}-{owner}", base.buckets, placed, notes)
    if not set(folders) <= set(touched):
        raise ValueError(f"rows of other buckets: {sorted(set(folders) - set(touched))}")
    return Written(path, base, touched, owner, folders, largest)


def name_version(spark: SparkSession, written: Written) -> Snapshot:
    """Put written buckets in the place of what their ``base`` has there.

    What other jobs have done to other buckets since ``base`` stays; if they changed one of these, ``VersionTaken`` is
    raised and nothing is changed.
    """
    path, base, touched = written.path, written.base, written.touched
    for _ in range(RACES):
        top = newest(spark, path)
        moved = [b for b in touched if top.folders.get(b) != base.folders.get(b)]
        if moved:
            raise VersionTaken(f"{path}: buckets {moved} have changed since version {base.version}")
        kept = {b: f for b, f in top.folders.items() if b not in set(touched)}
        # Numbers whose file was never finished are passed over.
        record = replace(top, version=max(_versions(spark, path)) + 1, owner=written.owner,
                         last_id=max(written.largest, top.last_id), folders={**kept, **written.folders})
        if files.create(spark, f"{path}/versions/{record.version}.json", _text(record)):
            return record
    raise VersionTaken(f"{path}: other jobs were faster {RACES} times")


def replace_buckets(rows: DataFrame, path: str, base: Snapshot, touched: Sequence[int], owner: str = "") -> Snapshot:
    """Write ``rows``, all rows of the ``touched`` buckets, and name the version that has them."""
    return name_version(rows.sparkSession, write_buckets(rows, path, base, touched, owner))
