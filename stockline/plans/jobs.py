"""End-to-end jobs: read the stored tables, run one plan, write the next version and the outbox.

The inventory lives in versions of seller buckets (``sources.snapshots``). A job reads the buckets of the sellers it is
about, writes only those, and names the next version. If another job has changed the same buckets meanwhile, the job is
run again from the newest version, up to ``ATTEMPTS`` times with growing pauses; then ``VersionTaken`` is raised.
Outbound records are written before the version is named, to a folder named by the job's owner: send those of the owners
that versions name.
"""

from __future__ import annotations

import functools
import random
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockline import schemas
from stockline.operators import edits, purchases
from stockline.operators.catalog import resolve_catalog
from stockline.operators.operations import complete_operations, moved_settings, start_guard, started_operations
from stockline.operators.products import chunk_index
from stockline.plans import bulk
from stockline.plans import reconcile as rec
from stockline.session import cut
from stockline.sources import readers, snapshots, writers
from stockline.streaming.fold_log import FoldLog
from stockline.streaming.stock import settled_inventory

ATTEMPTS, PAUSE_SECONDS = 5, 0.5


def repeated(job: Callable) -> Callable:
    """Run a job again, from the newest version, when another one was faster."""
    @functools.wraps(job)
    def run(*args, **kwargs):
        for attempt in range(1, ATTEMPTS + 1):
            try:
                return job(*args, **kwargs)
            except snapshots.VersionTaken:
                if attempt == ATTEMPTS:
                    raise
                time.sleep(PAUSE_SECONDS * 2 ** attempt * random.uniform(0.5, 1))
    return run


def _now() -> Column:
    """The present time, taken once: the same whenever the result is read."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


@dataclass(frozen=True)
class _Work:
    """What a job reads and replaces: the buckets of some sellers, as they are in the newest version."""

    path: str
    base: snapshots.Snapshot
    buckets: list[int]
    inventory: DataFrame
    owner: str

    @staticmethod
    def on(path: str, *sellers: DataFrame) -> _Work:
        spark = sellers[0].sparkSession
        base = snapshots.snapshot(spark, path)
        buckets = snapshots.touched_buckets(base, *sellers)
        rows = snapshots.read_buckets(spark, path, base, schemas.INVENTORY, buckets)
        return _Work(path, base, buckets, rows, uuid.uuid4().hex)

    def outbox(self, path: str, kind: str) -> str:
        return f"{path}/{kind}={self.base.version + 1}/owner={self.owner}"

    def write(self, placed: DataFrame, notes: Sequence[str] = ()) -> snapshots.Written:
        return snapshots.write_buckets(placed, self.path, self.base, self.buckets, self.owner, True, notes)

    def store(self, inventory: DataFrame) -> snapshots.Snapshot:
        return snapshots.replace_buckets(inventory, self.path, self.base, self.buckets, self.owner)


@repeated
def run_import(spark: SparkSession, export_path: str, catalog_path: str, inventory_path: str,
               multiline: bool = True, sellers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Import all exports, or those of ``sellers`` (user_id); returns (summary per seller, progress per
    batch of chunks). Products are classified once; their outcomes give the counts and the new inventory."""
    rows = readers.read_export(spark, export_path, multiline=multiline)
    if sellers is not None:
        rows = rows.join(sellers.select("user_id").distinct(), "user_id", "left_semi")
    used = ["user_id", "id", "blueprint_id", "quantity", "price_cents", "properties_hash"]
    export = cut(rows.select(*used, "seq"), "export")
    work = _Work.on(inventory_path, export)
    resolved = resolve_catalog(readers.read_catalog(spark, catalog_path))
    classified = bulk.classify_export(chunk_index(export), resolved, work.inventory)
    outcomes = cut(classified.select(*used, "chunk", "outcome"), "outcomes")
    chunks = cut(bulk.chunk_summary(outcomes), "chunks")
    created = chunks.agg(F.sum("created")).first()[0] or 0
    first_id = snapshots.take_ids(spark, inventory_path, created) if created else 0
    work.store(bulk.merge_outcomes(outcomes, work.inventory, _now(), first_id))
    summary = chunks.groupBy("user_id").agg(
        F.sum("processed").alias("total_products"),
        *[F.sum(c).alias(c) for c in ("processed", "created", "updated", "skipped")])
    return summary, bulk.sync_progress(chunks)


def finish_operations(operations: DataFrame, summary: DataFrame, completed_at) -> DataFrame:
    """Mark the pending imports of the summed-up sellers as completed."""
    fields = ["total_products", "processed", "created", "updated", "skipped"]
    pending = operations.where((F.col("operation_type") == "bulk_sync") & (F.col("status") == "pending"))
    known = operations.schema["operation_metadata"].dataType
    metadata = F.struct(*[(F.col(f.name) if f.name in fields else F.lit(None)).cast(f.dataType).alias(f.name)
                          for f in known.fields])
    results = pending.select("operation_id", "user_id").join(summary, "user_id").select(
        "operation_id", completed_at.alias("completed_at"), metadata.alias("operation_metadata"))
    return complete_operations(operations, results)


@dataclass(frozen=True)
class Import:
    """Result of ``run_requested_import``; ``failure`` is its error, ``progress`` is null then."""

    answers: DataFrame
    settings: DataFrame
    operations: DataFrame
    progress: DataFrame | None
    failure: str | None


def run_requested_import(spark: SparkSession, requests: DataFrame, settings: DataFrame, operations: DataFrame,
                         export_path: str, catalog_path: str, inventory_path: str, multiline: bool = True,
                         on_start: Callable[[DataFrame, DataFrame], None] | None = None) -> Import:
    """Import for the sellers who ask and may: operations are entered, and sellers and operations move
    with the import.

    ``requests`` has user_id, operation_id and force. ``answers`` tells who was refused and why.
    Allowed sellers become active, or error if the import fails, and then their operations stay pending. A seller
    without any product is done with zero of everything. ``on_start`` is given the settings, with the allowed sellers in
    initial_sync, and the operations with their pending ones before the import begins, so that both can be shown while it
    runs. An import that was only slower than others on the same sellers is no failure of theirs: it is repeated, and
    ``VersionTaken`` is raised if that does not help.
    """
    asked_at = _now()
    answers = cut(start_guard(requests, settings), "answers")
    allowed = answers.where("allowed")
    pending = cut(started_operations(operations, allowed, now=asked_at), "operations")
    if on_start is not None:
        on_start(started(settings, allowed, asked_at), pending)
    try:
        counted, progress = run_import(spark, export_path, catalog_path, inventory_path, multiline, allowed)
    except snapshots.VersionTaken:
        raise
    except Exception as failure:
        after = moved_settings(settings, allowed, "error", _now(), str(failure))
        return Import(answers, after, pending, None, str(failure))
    done_at = _now()
    sellers = allowed.select("user_id").distinct()
    summary = sellers.join(counted, "user_id", "left").na.fill(0)
    asked = allowed.select("operation_id").distinct()
    done = finish_operations(pending.join(asked, "operation_id", "left_semi"), summary, done_at)
    others = pending.join(asked, "operation_id", "left_anti")
    return Import(answers, moved_settings(settings, allowed, "active", done_at),
                  others.unionByName(done.select(others.columns)), progress, None)


def started(settings: DataFrame, allowed: DataFrame, now: Column | None = None) -> DataFrame:
    """The settings while the import of ``allowed`` sellers runs."""
    return moved_settings(settings, allowed, "initial_sync", F.current_timestamp() if now is None else now)


@repeated
def run_reconcile(spark: SparkSession, export_path: str, catalog_path: str, inventory_path: str,
                  multiline: bool = True, blueprint_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Bring the inventory in line with the remote export, or with what it says of one blueprint;
    returns (summary, errors)."""
    export = cut(readers.read_export(spark, export_path, blueprint_id=blueprint_id, multiline=multiline), "export")
    work = _Work.on(inventory_path, export)
    resolved = resolve_catalog(readers.read_catalog(spark, catalog_path))
    outcomes = cut(rec.reconcile_outcomes(export, resolved, work.inventory), "outcomes")
    created = outcomes.where(F.col("outcome") == "created").count()
    first_id = snapshots.take_ids(spark, inventory_path, created) if created else 0
    work.store(bulk.assign_ids(rec.reconcile(outcomes, work.inventory, _now()), first_id))
    return rec.reconcile_summary(outcomes), rec.reconcile_errors(outcomes)


@repeated
def run_edits(spark: SparkSession, patches: DataFrame, inventory_path: str, outbox_path: str,
              order: str = "seq") -> DataFrame:
    """Apply all valid patches and queue the items that must be sent out; returns refused patches.

    Items and patches go once to the tasks that write the buckets; what must be sent out is noted there and read back.
    Items whose stored properties are no JSON object keep them (``edits.broken_properties`` lists those
    patches).
    """
    checked = cut(edits.validate_patch(patches), "patches")
    accepted = checked.where(F.size("errors") == 0)
    work = _Work.on(inventory_path, accepted)
    place = snapshots.placing(work.base, work.inventory, accepted)
    joined = edits.place_patches(work.inventory, edits.collapse_patches(accepted, order), place,
                                 [snapshots.BUCKET, snapshots.SLICE])
    needed = edits.change_flags()["sync_needed"]
    written = work.write(edits.patched(joined.withColumn("sync_needed", needed), _now()), notes=["sync_needed"])
    edited = written.read(spark, f"{schemas.INVENTORY}, sync_needed boolean")
    due = edits.due_items(edited)
    writers.write_outbox(writers.update_outbox(edits.build_update_payload(due)), work.outbox(outbox_path, "update"))
    snapshots.name_version(spark, written)
    return checked.where(F.size("errors") > 0)


@repeated
def run_deletes(spark: SparkSession, requests: DataFrame, inventory_path: str, outbox_path: str) -> DataFrame:
    """Delete items and queue the remote deletes; returns requests that name no item."""
    work = _Work.on(inventory_path, requests)
    kept, deleted, missing = edits.delete_items(work.inventory, requests)
    writers.write_outbox(writers.delete_outbox(deleted), work.outbox(outbox_path, "delete"))
    work.store(kept)
    return missing


@repeated
def run_purchases(spark: SparkSession, requests: DataFrame, export: DataFrame, inventory_path: str,
                  outbox_path: str, settings: DataFrame | None = None) -> DataFrame:
    """Decide purchases, lower the stock and queue the remote changes; returns the decisions.

    With ``settings``, sellers without settings or token sell nothing.
    """
    work = _Work.on(inventory_path, requests)
    decided = cut(purchases.decide_purchases(requests, work.inventory, export, settings), "decided")
    product = F.expr("try_cast(external_stock_id as bigint)")
    remote = decided.where(F.col("remote_action").isNotNull()).select(
        "user_id", "request_id", product.alias("product_id"), F.col("remote_action").alias("action"),
        F.col("remote_delta").alias("delta_quantity"))
    writers.write_outbox(remote, work.outbox(outbox_path, "purchase"))
    work.store(purchases.settle_purchases(work.inventory, decided, _now()))
    return decided


@repeated
def run_settle(spark: SparkSession, inventory_path: str, ledger_path: str) -> int:
    """Write what the streaming ledger has changed so far as the next version; returns its number.

    The stream must be stopped; it then goes on with the same checkpoint, the new version and a
    fresh ledger folder, so that its log never grows beyond one version's time.
    """
    changed = FoldLog.open(spark, ledger_path).folds(spark).select("user_id")
    work = _Work.on(inventory_path, changed)
    return work.store(settled_inventory(work.inventory, ledger_path, _now())).version
