"""Sellers' synchronisation settings and the log of operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockline.functions.quality import same_owner
from stockline.operators.scan import keep_one

BUSY = ["initial_sync", "active"]
PROGRESS_FIELDS = ["progress_percent", "total_chunks", "processed_chunks", "total_products", "processed",
                   "created", "updated", "skipped"]


def start_guard(requests: DataFrame, settings: DataFrame) -> DataFrame:
    """Who may start a synchronisation (``requests``: user_id, force), else the reason. Of several requests of a seller
    with an operation_id that may start, the one with the least starts, and the others find it in progress."""
    joined = requests.join(
        settings.select("user_id", "has_token", "sync_status", F.lit(True).alias("_known")), "user_id", "left")
    reason = (F.when(F.col("_known").isNull(), "settings not found")
              .when(~F.coalesce("has_token", F.lit(False)), "no token")
              .when(~F.coalesce("force", F.lit(False)) & F.col("sync_status").isin(BUSY),
                    F.concat(F.lit("sync in progress: "), F.col("sync_status"))))
    judged = joined.withColumn("reason", reason).select(*requests.columns, "reason")
    if "operation_id" in requests.columns:
        first = judged.where(F.col("reason").isNull()).groupBy("user_id").agg(F.min("operation_id").alias("_first"))
        second = F.col("reason").isNull() & (F.col("operation_id") != F.col("_first"))
        judged = judged.join(first, "user_id", "left").withColumn(
            "reason", F.when(second, f"sync in progress: {BUSY[0]}").otherwise(F.col("reason")))
    return judged.select(*requests.columns, F.col("reason").isNull().alias("allowed"), "reason")


def started_operations(operations: DataFrame, allowed: DataFrame, op_type: str = "bulk_sync",
                       now: Column | None = None) -> DataFrame:
    """The log with a pending operation per allowed request (user_id, operation_id)."""
    new = allowed.select("user_id", "operation_id", F.lit(op_type).alias("operation_type"),
                         F.lit("pending").alias("status"),
                         (F.current_timestamp() if now is None else now).alias("created_at"))
    return insert_operations(operations, new)


def moved_settings(settings: DataFrame, sellers: DataFrame, status: str, now: Column,
                   error: str | None = None) -> DataFrame:
    """The settings after ``sellers`` (user_id) went to ``status``: active also sets the time of the
    last import and clears the error, error sets its text."""
    moved = sellers.select("user_id").distinct().withColumn("_moved", F.lit(True))
    given = F.col("_moved").isNotNull()
    changes = {"sync_status": F.lit(status), "updated_at": now}
    if status == "active":
        changes |= {"last_sync_at": now, "last_error": F.lit(None).cast("string")}
    if status == "error":
        changes["last_error"] = F.lit(error)
    return settings.join(moved, "user_id", "left").withColumns({
        name: F.when(given, value).otherwise(F.col(name)) for name, value in changes.items()}).select(*settings.columns)


def operation_access(requests: DataFrame, operations: DataFrame) -> DataFrame:
    """Whether a requester (requester_id) may see an operation (operation_id)."""
    joined = requests.join(
        operations.select("operation_id", F.col("user_id").alias("_owner")), "operation_id", "left")
    # The texts of the reasons.
    reason = (F.when(F.col("_owner").isNull(), "Access denied: Could not verify task ownership")
              .when(F.col("_owner") != F.col("requester_id"),
                    "Access denied: Task does not belong to authenticated user"))
    return joined.select(*requests.columns, reason.isNull().alias("allowed"), reason.alias("reason"))


def owner_match(requests: DataFrame, left: str = "token_user", right: str = "path_user") -> DataFrame:
    return requests.withColumn("matches", same_owner(F.col(left), F.col(right)))


def task_message(state: Column, ok: Column) -> Column:
    """Text for a task; ``ok`` is null while it runs."""
    # The texts of the states.
    return (F.when(ok, "Task completed successfully").when(~ok, "Task failed")
            .when(state == "PENDING", "Task is waiting to be processed")
            .when(state == "STARTED", "Task is currently running")
            .when(state == "RETRY", "Task is being retried")
            .otherwise(F.concat(F.lit("Task state: "), state)))


def latest_operation(users: DataFrame, operations: DataFrame, op_type: str = "bulk_sync") -> DataFrame:
    """Newest operation per user with its progress; absent numbers are 0."""
    fields = [f for f in PROGRESS_FIELDS if f in operations.schema["operation_metadata"].dataType.names]
    newest = (operations.where(F.col("operation_type") == op_type).groupBy("user_id")
              .agg(F.max_by(F.struct("operation_id", "status", "created_at", "operation_metadata"),
                            F.struct("created_at", "operation_id")).alias("op")))
    return users.join(newest, "user_id", "left").select(
        "user_id", F.col("op.operation_id").alias("operation_id"),
        F.coalesce("op.status", F.lit("no_sync_found")).alias("status"),
        *[F.coalesce(F.col(f"op.operation_metadata.{f}"), F.lit(0)).alias(f) for f in fields],
        F.col("op.created_at").alias("created_at"))


def insert_operations(log: DataFrame, new: DataFrame, order: str = "created_at") -> DataFrame:
    """Append operations whose id is not there yet; of copies inside ``new`` the first one counts."""
    first = keep_one(new, ["operation_id"], F.col(order).asc_nulls_last())
    return log.unionByName(first.join(log.select("operation_id"), "operation_id", "left_anti"),
                           allowMissingColumns=True)


def complete_operations(operations: DataFrame, results: DataFrame) -> DataFrame:
    """Mark operations as completed (``results``: operation_id, completed_at, operation_metadata)."""
    done = results.select("operation_id", F.col("completed_at").alias("_at"),
                          F.col("operation_metadata").alias("_metadata"))
    finished = F.col("_at").isNotNull()
    before = F.col("completed_at") if "completed_at" in operations.columns else F.lit(None)
    columns = [c for c in operations.columns if c not in ("status", "operation_metadata", "completed_at")]
    return operations.join(done, "operation_id", "left").select(
        *columns, F.when(finished, "completed").otherwise(F.col("status")).alias("status"),
        F.when(finished, F.col("_metadata")).otherwise(F.col("operation_metadata")).alias("operation_metadata"),
        F.coalesce("_at", before).alias("completed_at"))


def sync_status(events: DataFrame) -> DataFrame:
    """Where each user stands after their events (event, ts, seq, error, webhook_secret).

    start, success, failure, suspend, remove and setup each set the status; each other field comes
    from the last event that sets it. All of it is one aggregate with map-side merging, so a user
    with very many events costs one row per task.
    """
    event = F.col("event")
    at = F.struct("ts", "seq")

    def last(value: Column, *kinds: str) -> Column:
        # max_by returns the value at the largest order; rows of other kinds order as null.
        return F.max_by(value, F.when(event.isin(*kinds), at))

    status = (F.when(event == "start", "initial_sync").when(event == "success", "active")
              .when(event == "failure", "error").otherwise("idle"))
    return events.groupBy("user_id").agg(
        F.max_by(status, at).alias("sync_status"),
        last(F.col("ts"), "success").alias("last_sync_at"),
        last(F.when(event == "failure", F.col("error")), "success", "failure").alias("last_error"),
        last(event == "setup", "setup", "remove").alias("has_token"),
        last(F.when(event == "setup", F.col("webhook_secret")), "setup", "remove").alias("webhook_secret"))


def iso_text(ts: Column) -> Column:
    """ISO 8601 in UTC, with microseconds only if there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))


def status_report(settings: DataFrame) -> DataFrame:
    return settings.select(
        "user_id", "sync_status", iso_text(F.col("last_sync_at")).alias("last_sync_at"), "last_error",
        F.when(~F.coalesce("has_token", F.lit(False)), True).alias("disconnected"))


def upsert_settings(settings: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """Insert users, or overwrite token flag and secret and reset the status; creation time stays.

    ``incoming`` has user_id, has_token and webhook_secret.
    """
    fresh = incoming.select("user_id", F.col("has_token").alias("_token"),
                            F.col("webhook_secret").alias("_secret"), F.lit(True).alias("_given"))
    joined = settings.withColumn("_known", F.lit(True)).join(fresh, "user_id", "full")
    given = F.col("_given").isNotNull()
    return joined.withColumns({
        "has_token": F.when(given, F.col("_token")).otherwise(F.col("has_token")),
        "webhook_secret": F.when(given, F.col("_secret")).otherwise(F.col("webhook_secret")),
        "sync_status": F.when(given, "idle").otherwise(F.col("sync_status")),
        "created_at": F.when(F.col("_known").isNull(), now).otherwise(F.col("created_at")),
        "updated_at": F.when(given, now).otherwise(F.col("updated_at")),
    }).select(*settings.columns)
