"""Registered queries: settings, operations, telemetry and rate limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockline import fixtures as fx
from stockline.operators import operations as op
from stockline.operators import telemetry as tm
from stockline.operators import throttle as th
from stockline.registry.views import with_views

QUERIES = {}


def query(sql=None):
    def add(function):
        QUERIES[function.__name__] = (function, sql)
        return function
    return add


@query(with_views("settings", """
    SELECT c_custkey AS user_id, c_custkey%8=0 AS force, r.reason IS NULL AS allowed, r.reason AS reason
    FROM customer LEFT JOIN settings s ON s.user_id=c_custkey,
    LATERAL (SELECT CASE WHEN s.user_id IS NULL THEN 'settings not found' WHEN NOT has_token THEN 'no token'
       WHEN c_custkey%8<>0 AND sync_status IN ('initial_sync','active') THEN 'sync in progress: '||sync_status END AS reason) r"""))
def start_guard(spark, sf_dir):
    user = F.col("c_custkey")
    wanted = fx.table(spark, sf_dir, "customer").select(user.alias("user_id"), (user % 8 == 0).alias("force"))
    return op.start_guard(wanted, fx.settings(spark, sf_dir))


_ACCESS = """
    SELECT e.event_id*2 AS operation_id, e.user_id AS requester_id, o_orderkey IS NOT NULL AND o_custkey=e.user_id AS allowed,
           CASE WHEN o_orderkey IS NULL THEN 'Access denied: Could not verify task ownership'
                WHEN o_custkey<>e.user_id THEN 'Access denied: Task does not belong to authenticated user' END AS reason
    FROM events e LEFT JOIN orders ON o_orderkey=e.event_id*2"""


@query(_ACCESS)
def operation_access(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "events").select(
        (F.col("event_id") * 2).alias("operation_id"), F.col("user_id").alias("requester_id"))
    return op.operation_access(wanted, fx.operations(spark, sf_dir))


@query(f"""
    SELECT o_orderkey AS request_id, CASE o_orderkey%4 WHEN 0 THEN true WHEN 1 THEN o_custkey=o_orderkey
           WHEN 2 THEN true ELSE false END AS matches FROM orders""")
def owner_match(spark, sf_dir):
    order, user = F.col("o_orderkey"), F.col("o_custkey")
    uuid = fx.uuid_text(user)
    other = (F.when(order % 4 == 0, F.upper(F.replace(uuid, F.lit("-"), F.lit(""))))
             .when(order % 4 == 1, fx.uuid_text(order)).when(order % 4 == 2, F.lit("plain"))
             .otherwise(F.concat(uuid, F.lit("?"))))
    pairs = fx.table(spark, sf_dir, "orders").select(
        order.alias("request_id"), F.when(order % 4 == 2, "plain").otherwise(uuid).alias("token_user"),
        other.alias("path_user"))
    return op.owner_match(pairs).select("request_id", "matches")


@query("""
    SELECT event_id, CASE event_id%6 WHEN 0 THEN 'Task completed successfully' WHEN 1 THEN 'Task failed'
           WHEN 2 THEN 'Task is waiting to be processed' WHEN 3 THEN 'Task is currently running'
           WHEN 4 THEN 'Task is being retried' ELSE 'Task state: '||event_type END AS message FROM events""")
def task_message(spark, sf_dir):
    number = F.col("event_id") % 6
    state = (F.when(number == 2, "PENDING").when(number == 3, "STARTED").when(number == 4, "RETRY")
             .otherwise(F.col("event_type")))
    ok = F.when(number == 0, True).when(number == 1, False)
    return fx.table(spark, sf_dir, "events").select("event_id", op.task_message(state, ok).alias("message"))


@query(with_views("operations", """
    , latest AS (SELECT * FROM operations WHERE operation_type='bulk_sync'
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, operation_id DESC)=1)
    SELECT c_custkey AS user_id, operation_id, coalesce(status,'no_sync_found') AS status,
           coalesce(progress_percent,0) AS progress_percent, coalesce(processed,0) AS processed, created_at
    FROM customer LEFT JOIN latest ON user_id=c_custkey"""))
def latest_operation(spark, sf_dir):
    users = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return op.latest_operation(users, fx.operations(spark, sf_dir))


@query(with_views("operations", """
    SELECT operation_id, user_id, status FROM operations
    UNION ALL SELECT operation_id, user_id, 'pending' FROM (SELECT l_orderkey*2 AS operation_id, min(l_linenumber) AS user_id
        FROM lineitem GROUP BY l_orderkey) WHERE operation_id NOT IN (SELECT operation_id FROM operations)"""))
def insert_operations(spark, sf_dir):
    log = fx.operations(spark, sf_dir).select("operation_id", "user_id", "status", "created_at")
    new = fx.table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 2).alias("operation_id"), F.col("l_linenumber").cast("long").alias("user_id"),
        F.lit("pending").alias("status"), F.timestamp_seconds("l_linenumber").alias("created_at"))
    return op.insert_operations(log, new).select("operation_id", "user_id", "status")


@query(with_views("operations", """
    SELECT operation_id, user_id, CASE WHEN status='pending' THEN 'completed' ELSE status END AS status,
           CASE WHEN status='pending' THEN 100 ELSE progress_percent END AS progress_percent,
           CASE WHEN status='pending' THEN created_at + INTERVAL 1 DAY END AS completed_at FROM operations"""))
def complete_operations(spark, sf_dir):
    operations = fx.operations(spark, sf_dir)
    results = operations.where(F.col("status") == "pending").select(
        "operation_id", (F.col("created_at") + F.expr("interval 1 day")).alias("completed_at"),
        F.struct(F.lit(100).alias("progress_percent"), F.lit(1).alias("processed")).alias("operation_metadata"))
    return op.complete_operations(operations, results).select(
        "operation_id", "user_id", "status", F.col("operation_metadata.progress_percent").alias("progress_percent"),
        "completed_at")


_STATUS = with_views("status_events", """
    , s AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn FROM status_events)
    , st AS (SELECT user_id,
        arg_max(CASE event WHEN 'start' THEN 'initial_sync' WHEN 'success' THEN 'active' WHEN 'failure' THEN 'error'
                ELSE 'idle' END, rn) AS sync_status,
        max(ts) FILTER (event='success') AS last_sync_at,
        max(CASE WHEN event IN ('success','failure') THEN rn END) AS e_rn,
        max(CASE WHEN event IN ('setup','remove') THEN rn END) AS t_rn FROM s GROUP BY user_id)
    , state AS (SELECT st.user_id, sync_status, last_sync_at, e.error AS last_error, t.event='setup' AS has_token,
        t.webhook_secret FROM st LEFT JOIN s e ON e.user_id=st.user_id AND e.rn=e_rn
        LEFT JOIN s t ON t.user_id=st.user_id AND t.rn=t_rn)""")


@query(_STATUS + "SELECT * FROM state")
def sync_status(spark, sf_dir):
    return op.sync_status(fx.status_events(spark, sf_dir))


@query(_STATUS + """
    SELECT user_id, sync_status, strftime(last_sync_at,'%Y-%m-%dT%H:%M:%S')||'+00:00' AS last_sync_at, last_error,
           CASE WHEN NOT coalesce(has_token,false) THEN true END AS disconnected FROM state""")
def status_report(spark, sf_dir):
    return op.status_report(op.sync_status(fx.status_events(spark, sf_dir)))


@query(with_views("settings", """
    SELECT coalesce(user_id,c_custkey) AS user_id, CASE WHEN c_custkey IS NULL THEN has_token ELSE true END AS has_token,
           CASE WHEN c_custkey IS NULL THEN webhook_secret ELSE 'c' END AS webhook_secret,
           CASE WHEN c_custkey IS NULL THEN sync_status ELSE 'idle' END AS sync_status, last_error,
           CASE WHEN user_id IS NULL THEN TIMESTAMP '2030-01-01' ELSE TIMESTAMP '2020-01-01' END AS created_at,
           CASE WHEN c_custkey IS NULL THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2030-01-01' END AS updated_at
    FROM settings FULL JOIN (SELECT c_custkey+50 AS c_custkey FROM customer) ON c_custkey=user_id"""))
def upsert_settings(spark, sf_dir):
    then = F.lit("2020-01-01 00:00:00").cast("timestamp")
    current = fx.settings(spark, sf_dir).drop("last_sync_at").withColumns({"created_at": then, "updated_at": then})
    incoming = fx.table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 50).alias("user_id"), F.lit(True).alias("has_token"), F.lit("c").alias("webhook_secret"))
    return op.upsert_settings(current, incoming, F.lit("2030-01-01 00:00:00").cast("timestamp"))


@query(with_views("metric_events", """
    SELECT name, label, CAST(sum(value) AS DOUBLE) AS total FROM metric_events GROUP BY name, label"""))
def counter_totals(spark, sf_dir):
    return tm.counter_totals(fx.metric_events(spark, sf_dir), ["label"]).withColumn("total", F.col("total").cast("double"))


_LAST = with_views("metric_events", """
    , last AS (SELECT * FROM metric_events
        QUALIFY row_number() OVER (PARTITION BY name, label ORDER BY ts DESC, seq DESC)<=200)""")


@query(_LAST + "SELECT name, label, seq FROM last")
def last_n_values(spark, sf_dir):
    return tm.last_n_values(fx.metric_events(spark, sf_dir), ["label"], 200).select("name", "label", "seq")


@query(with_views("metric_events", """
    SELECT name, label, count(*) AS count, CAST(min(value) AS DOUBLE) AS min, CAST(max(value) AS DOUBLE) AS max,
           CAST(sum(value) AS DOUBLE)/count(*) AS avg FROM metric_events GROUP BY name, label"""))
def histogram_stats(spark, sf_dir):
    stats = tm.histogram_stats(fx.metric_events(spark, sf_dir), ["label"])
    return stats.withColumns({"min": F.col("min").cast("double"), "max": F.col("max").cast("double")})


@query(with_views("metric_events", """
    SELECT name, label, b.le AS le, count(*) FILTER (b.bound IS NULL OR CAST(value AS DOUBLE)<=b.bound) AS bucket,
           count(*) AS count, CAST(sum(value) AS DOUBLE) AS sum
    FROM metric_events, (VALUES ('0.1',0.1),('0.5',0.5),('1.0',1.0),('2.5',2.5),('5.0',5.0),('10.0',10.0),('30.0',30.0),
         ('60.0',60.0),('180.0',180.0),('+Inf',NULL)) b(le,bound) GROUP BY name, label, b.le"""))
def bucket_histogram(spark, sf_dir):
    histogram = tm.bucket_histogram(fx.metric_events(spark, sf_dir), tm.BUCKETS["api"], ["name", "label"])
    return histogram.withColumn("sum", F.col("sum").cast("double"))


@query(with_views("metric_events", """
    SELECT name, label, CAST(value AS DOUBLE) AS value FROM metric_events
    QUALIFY row_number() OVER (PARTITION BY name, label ORDER BY ts DESC, seq DESC)=1"""))
def gauge_latest(spark, sf_dir):
    return tm.gauge_latest(fx.metric_events(spark, sf_dir), ["label"]).withColumn("value", F.col("value").cast("double"))


@query(with_views("requests", """
    SELECT 'GET' AS method, endpoint, status_code, count(*) AS total FROM requests GROUP BY endpoint, status_code"""))
def labelled_counts(spark, sf_dir):
    return tm.labelled_counts(fx.requests(spark, sf_dir).withColumn("method", F.lit("GET")),
                              tm.COUNTER_LABELS["http_requests"])


@query("""
    WITH h AS (SELECT CAST(ts AS DATE) AS day, user_id,
        CASE WHEN event_type='error' AND value>40 THEN 'unhealthy' WHEN event_type='signup' AND value>60 THEN 'slow'
             ELSE 'healthy' END AS status FROM events)
    SELECT day, user_id, CASE WHEN bool_and(status='healthy') THEN 'healthy' WHEN bool_or(status='unhealthy')
           THEN 'unhealthy' ELSE 'degraded' END AS status FROM h GROUP BY day, user_id""")
def health_rollup(spark, sf_dir):
    kind, value = F.col("event_type"), F.col("value")
    status = (F.when((kind == "error") & (value > 40), "unhealthy").when((kind == "signup") & (value > 60), "slow")
              .otherwise("healthy"))
    checks = fx.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "user_id",
                                                      status.alias("status"))
    return tm.health_rollup(checks, ["day", "user_id"])


@query(with_views("requests", """
    SELECT endpoint, CASE WHEN request_id%10=0 THEN 'network_error' ELSE 'api_error' END AS error_type,
           count(*) AS failures FROM requests
    WHERE request_id%10=0 OR (status_code>=400 AND status_code<>429) GROUP BY ALL"""))
def failure_types(spark, sf_dir):
    requests = fx.requests(spark, sf_dir).withColumn(
        "status_code", F.when(F.col("request_id") % 10 != 0, F.col("status_code")))
    return tm.failure_types(requests, ["endpoint"])


@query(with_views("requests", """
    , ranked AS (SELECT endpoint, duration_s, row_number() OVER (PARTITION BY endpoint ORDER BY duration_s) AS rn,
                 count(*) OVER (PARTITION BY endpoint) AS n FROM requests)
    , p AS (SELECT endpoint, min(duration_s) FILTER (rn>=ceil(n*CAST(0.5 AS DOUBLE))) AS p50,
            min(duration_s) FILTER (rn>=ceil(n*CAST(0.95 AS DOUBLE))) AS p95,
            min(duration_s) FILTER (rn>=ceil(n*CAST(0.99 AS DOUBLE))) AS p99 FROM ranked GROUP BY endpoint)
    SELECT r.endpoint, count(*) AS requests,
           CAST(count(*) AS DOUBLE)/greatest(1, CAST(floor(epoch(max(ts))) AS BIGINT)-CAST(floor(epoch(min(ts))) AS BIGINT)) AS rate,
           CAST(count(*) FILTER (status_code BETWEEN 400 AND 499) AS DOUBLE)/count(*) AS share_4xx,
           CAST(count(*) FILTER (status_code>=500) AS DOUBLE)/count(*) AS share_5xx,
           count(*) FILTER (status_code=429) AS throttled, count(DISTINCT user_id) AS active_users,
           any_value(p50) AS p50, any_value(p95) AS p95, any_value(p99) AS p99
    FROM requests r JOIN p ON p.endpoint=r.endpoint GROUP BY r.endpoint"""))
def latency_report(spark, sf_dir):
    return tm.latency_report(fx.requests(spark, sf_dir))


@query(with_views("requests", """
    SELECT r.request_id, r.user_id, count(h.request_id) AS recent_429s
    FROM requests r LEFT JOIN requests h ON h.user_id=r.user_id AND h.status_code=429 AND h.ts<=r.ts
         AND h.ts>r.ts-INTERVAL 1 DAY GROUP BY r.request_id, r.user_id"""))
def recent_throttles(spark, sf_dir):
    return tm.recent_throttles(fx.requests(spark, sf_dir), 86_400).select("request_id", "user_id", "recent_429s")


@query(with_views("requests", """
    , f AS (SELECT ts, request_id, lag(ts) OVER w AS before FROM requests WHERE status_code>=400 AND status_code<>429
            WINDOW w AS (ORDER BY ts, request_id))
    , s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts-before>=INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
                   OVER (ORDER BY ts, request_id) AS session FROM f)
    SELECT min(ts) AS started_at, min(ts) FILTER (rn=5) AS opened_at, max(ts) AS ended_at, count(*) AS failures
    FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, request_id) AS rn FROM s)
    GROUP BY session HAVING count(*)>=5"""))
def outage_sessions(spark, sf_dir):
    return tm.outage_sessions(fx.requests(spark, sf_dir), (), 1800, 5)


_BUCKET_WALK = with_views("requests", """
    , q AS (SELECT user_id, request_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS k
            FROM requests)
    , walk AS (SELECT user_id, request_id, ts, t, k, t AS start, 1 AS used, true AS allowed FROM q WHERE k=1
        UNION ALL
        SELECT q.user_id, q.request_id, q.ts, q.t, q.k, CASE WHEN q.t>=w.start+21600000000 THEN q.t ELSE w.start END,
               CASE WHEN q.t>=w.start+21600000000 THEN 1 ELSE least(w.used+1,4) END,
               q.t>=w.start+21600000000 OR w.used<3
        FROM walk w JOIN q ON q.user_id=w.user_id AND q.k=w.k+1)""")


@query(_BUCKET_WALK + """
    SELECT user_id, request_id, ts, make_timestamp(start) AS bucket_start, allowed,
           CASE WHEN NOT allowed THEN CAST(start+21600000000-t AS DOUBLE)/1000000.0 END AS wait_seconds FROM walk""")
def throttle_audit(spark, sf_dir):
    return th.throttle_audit(fx.requests(spark, sf_dir), 3, 21_600, slice_windows=8)


# The log is squeezed by 200, so that five minutes and one hour matter.
_SQUEEZED = """
    , r AS (SELECT user_id%5 AS user_id, request_id, make_timestamp(1700000000000000+epoch_us(ts)//200) AS ts, status_code
            FROM requests)"""
_FACTOR_WALK = with_views("requests", _SQUEEZED + """
    , q AS (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) AS k
            FROM r WHERE status_code=429 OR status_code<400)
    , walk AS (
        SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS TIMESTAMP) AS ts,
               CAST(1.0 AS DOUBLE) AS f, CAST(NULL AS BIGINT) AS changed, CAST(NULL AS BIGINT) AS last_hit FROM q WHERE k=1
        UNION ALL
        SELECT user_id, k, request_id, ts,
               CASE WHEN hit THEN greatest(CAST(0.5 AS DOUBLE), f0*CAST(0.9 AS DOUBLE))
                    WHEN up THEN least(CAST(1.5 AS DOUBLE), f0*CAST(1.01 AS DOUBLE)) ELSE f0 END,
               CASE WHEN hit OR up THEN t ELSE changed END, CASE WHEN hit THEN t ELSE last_hit END
        FROM (SELECT q.user_id, q.k, q.request_id, q.ts, q.t, q.status_code=429 AS hit, w.changed, w.last_hit,
                     CASE WHEN w.changed IS NULL OR q.t-w.changed>=3600000000 THEN CAST(1.0 AS DOUBLE) ELSE w.f END AS f0,
                     q.status_code<>429 AND (w.last_hit IS NULL OR q.t-w.last_hit>=300000000)
                     AND CASE WHEN w.changed IS NULL OR q.t-w.changed>=3600000000 THEN CAST(1.0 AS DOUBLE) ELSE w.f END<1.0 AS up
              FROM walk w JOIN q ON q.user_id=w.user_id AND q.k=w.k+1))""")


def squeezed_requests(spark, sf_dir):
    micros = F.floor(F.unix_micros("ts") / F.lit(200)) + 1_700_000_000_000_000
    return fx.requests(spark, sf_dir).select(
        (F.col("user_id") % 5).alias("user_id"), "request_id", F.timestamp_micros(micros).alias("ts"), "status_code")


@query(_FACTOR_WALK + """
    SELECT user_id, request_id, ts, CASE WHEN changed IS NULL OR epoch_us(ts)-changed>=3600000000 THEN CAST(1.0 AS DOUBLE) ELSE f END AS factor,
           CAST(trunc(CASE WHEN changed IS NULL OR epoch_us(ts)-changed>=3600000000 THEN CAST(1.0 AS DOUBLE) ELSE f END*200) AS INT)
           AS effective_limit FROM walk WHERE k>0""")
def adaptive_limits(spark, sf_dir):
    return th.adaptive_limits(squeezed_requests(spark, sf_dir)).drop("changed_at")


_AS_OF = "2024-02-21 15:30:00"


@query(_FACTOR_WALK.replace("FROM r WHERE", f"FROM r WHERE ts<=TIMESTAMP '{_AS_OF}' AND") .replace(
    "status_code=429 OR status_code<400)", "(status_code=429 OR status_code<400))") + f"""
    , kinds AS (SELECT user_id, ts, request_id, status_code=429 AS hit FROM r
                WHERE ts<=TIMESTAMP '{_AS_OF}' AND (status_code=429 OR status_code<400))
    , g AS (SELECT *, CASE WHEN ts-lag(ts) OVER w<INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM kinds
            WINDOW w AS (PARTITION BY user_id, hit ORDER BY ts, request_id))
    , h AS (SELECT *, sum(s) OVER (PARTITION BY user_id, hit ORDER BY ts, request_id) AS session FROM g)
    , c AS (SELECT user_id, hit, session, count(*) AS n, max(ts) AS last FROM h GROUP BY user_id, hit, session
            QUALIFY row_number() OVER (PARTITION BY user_id, hit ORDER BY session DESC)=1)
    , live AS (SELECT * FROM c WHERE TIMESTAMP '{_AS_OF}'-last<INTERVAL 1 HOUR)
    , f AS (SELECT user_id, CASE WHEN epoch_us(TIMESTAMP '{_AS_OF}')-changed<3600000000 THEN f ELSE CAST(1.0 AS DOUBLE) END AS f
            FROM walk QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k DESC)=1)
    SELECT u.user_id, 200 AS base_limit, coalesce(f.f,1.0) AS adaptive_factor,
           CAST(trunc(coalesce(f.f,1.0)*200) AS INT) AS effective_limit,
           coalesce((SELECT n FROM live l WHERE l.user_id=u.user_id AND hit),0) AS count_429_1h,
           coalesce((SELECT n FROM live l WHERE l.user_id=u.user_id AND NOT hit),0) AS success_count_1h,
           (SELECT count(*) FROM r WHERE r.user_id=u.user_id AND status_code=429 AND ts<=TIMESTAMP '{_AS_OF}'
                  AND ts>TIMESTAMP '{_AS_OF}'-INTERVAL 5 MINUTE) AS recent_429s_5m
    FROM (SELECT DISTINCT user_id FROM r WHERE ts<=TIMESTAMP '{_AS_OF}') u LEFT JOIN f ON f.user_id=u.user_id""")
def user_throttle_stats(spark, sf_dir):
    return th.user_throttle_stats(squeezed_requests(spark, sf_dir), F.lit(_AS_OF).cast("timestamp"))
