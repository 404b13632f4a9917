"""Queries of the queue over the lifted tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import inspect as I
from tidemark.operators import timers
from tidemark.operators import transitions as T
from tidemark.plans import oracle as O
from tidemark.sources import commits
from tidemark.sources import stored as L

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
MAIN = "main"


def query(sql: str | None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


# --- statistics -----------------------------------------------------------------------------


def _count(states, where="true", prefix=""):
    return ", ".join(f"count(*) FILTER ({where} AND status = '{s}') AS {prefix}{s}" for s in states)


_PRIORITY = ", ".join(f"count(*) FILTER (status = 'pending' AND priority = {p}) AS {{0}}{n.lower()}" for p, n in S.PRIORITIES.items())
_WORKERS = "count(DISTINCT current_worker_id) FILTER (status = 'processing') AS active_workers"
_CAPACITY = f"SELECT nullif(coalesce(sum(max_workers), 0), 0)::BIGINT AS max_workers FROM pools WHERE queue_name = 'main' AND last_seen_at > {O.AS_OF} - INTERVAL 60 SECOND"


@query(O.over(f"SELECT {_count(I.OPEN_STATES)} FROM acts WHERE queue_name = 'main'"))
def stats_status(spark, sf_dir) -> DataFrame:
    return I.stats_status(L.activities(spark, sf_dir), MAIN)


@query(O.over(f"SELECT {_WORKERS} FROM acts WHERE queue_name = 'main'"))
def stats_active_workers(spark, sf_dir) -> DataFrame:
    return I.stats_active_workers(L.activities(spark, sf_dir), MAIN)


@query(O.over(f"SELECT {_count(I.ALL_STATES, prefix='root_')} FROM acts WHERE queue_name = 'main' AND parent_activity_id IS NULL"))
def stats_roots(spark, sf_dir) -> DataFrame:
    return I.stats_roots(L.activities(spark, sf_dir), MAIN)


@query(O.over(f"SELECT {_PRIORITY.format('')} FROM acts WHERE queue_name = 'main'"))
def stats_priority(spark, sf_dir) -> DataFrame:
    return I.stats_priority(L.activities(spark, sf_dir), MAIN)


@query("WITH " + O.POOLS + _CAPACITY)
def stats_capacity(spark, sf_dir) -> DataFrame:
    return I.stats_capacity(L.worker_pools(spark, sf_dir), MAIN, L.as_of())


@query(O.over(f"SELECT {_count(I.OPEN_STATES)}, {_WORKERS}, {_count(I.ALL_STATES, 'parent_activity_id IS NULL', 'root_')}, {_PRIORITY.format('priority_')}, ({_CAPACITY}) AS max_workers FROM acts WHERE queue_name = 'main'", O.POOLS))
def stats_all(spark, sf_dir) -> DataFrame:
    return I.stats(L.activities(spark, sf_dir), L.worker_pools(spark, sf_dir), MAIN, L.as_of())


# --- listings -------------------------------------------------------------------------------

_BY_STATUS = "priority DESC, retry_count DESC, created_at ASC NULLS LAST, id"


@query(O.listing("queue_name = 'main' AND status = 'pending'", _BY_STATUS))
def list_pending(spark, sf_dir) -> DataFrame:
    return I.by_status(L.activities(spark, sf_dir), MAIN, "pending")


@query(O.listing("queue_name = 'main' AND status = 'processing'", _BY_STATUS + " LIMIT 100 OFFSET 200", None))
def list_processing(spark, sf_dir) -> DataFrame:
    return I.by_status(L.activities(spark, sf_dir), MAIN, "processing", offset=200, limit=100)


@query(O.listing("queue_name = 'main' AND status IN ('scheduled', 'retrying', 'waiting')", "scheduled_at ASC NULLS LAST, created_at ASC NULLS LAST, id"))
def list_scheduled(spark, sf_dir) -> DataFrame:
    return I.scheduled(L.activities(spark, sf_dir), MAIN)


@query(O.listing("queue_name = 'main' AND status IN ('completed', 'failed') AND NOT cron", "completed_at DESC NULLS FIRST, created_at DESC, id", 500))
def list_completed_noncron(spark, sf_dir) -> DataFrame:
    return I.completed(L.activities(spark, sf_dir), MAIN, cron=False, limit=500)


@query(O.listing("queue_name = 'main' AND status IN ('completed', 'failed') AND cron", "completed_at DESC NULLS FIRST, created_at DESC, id"))
def list_completed_cron(spark, sf_dir) -> DataFrame:
    return I.completed(L.activities(spark, sf_dir), MAIN, cron=True)


@query(O.listing("queue_name = 'main' AND status = 'dead_letter'", "completed_at DESC NULLS FIRST, id", 200, f", coalesce(last_error, '') AS error, coalesce(completed_at, {O.AS_OF}) AS failed_at"))
def list_dead_letter(spark, sf_dir) -> DataFrame:
    return I.dead_letters(L.activities(spark, sf_dir), MAIN, L.as_of(), limit=200)


def _recent_sql(status, roots_only):
    where = "queue_name = 'main'" + (" AND parent_activity_id IS NULL" if roots_only else "") + (f" AND status = '{status}'" if status else "") + (" AND NOT cron" if status in ("completed", "failed") else "")
    column = {"completed": "completed_at", "failed": "last_error_at", "processing": "started_at", "scheduled": "scheduled_at", "retrying": "last_error_at", "dead_letter": "last_error_at"}.get(status, "NULL")
    return O.listing(where, f"coalesce({column}, created_at) DESC NULLS FIRST, id")


for _status in [None, *I.ALL_STATES]:
    query(_recent_sql(_status, True), f"recent_roots_{_status or 'all'}")(lambda spark, sf_dir, s=_status: I.recent(L.activities(spark, sf_dir), MAIN, s))
    query(_recent_sql(_status, False), f"recent_activities_{_status or 'all'}")(lambda spark, sf_dir, s=_status: I.recent(L.activities(spark, sf_dir), MAIN, s, roots_only=False))


@query(O.listing("queue_name = 'main' AND cron", "created_at DESC, id"))
def list_cron(spark, sf_dir) -> DataFrame:
    return I.cron(L.activities(spark, sf_dir), MAIN)


@query(O.listing("true", "id", None))
def snapshot(spark, sf_dir) -> DataFrame:
    return I.snapshot(L.activities(spark, sf_dir))


# --- one activity ---------------------------------------------------------------------------


@query(O.listing("id = 7000 AND queue_name = 'main'", "id", None))
def get_activity(spark, sf_dir) -> DataFrame:
    return I.activity(L.activities(spark, sf_dir), MAIN, 7000)


@query(O.over("SELECT activity_id, state, data FROM results WHERE activity_id = -7001", O.RESULTS))
def get_result(spark, sf_dir) -> DataFrame:
    return I.result(L.results(spark, sf_dir), -7001)


@query("WITH " + O.EVENTS + "SELECT id, activity_id, event_type, worker_id, detail, created_at FROM log WHERE activity_id = 7000 ORDER BY created_at, id LIMIT 50")
def activity_events(spark, sf_dir) -> DataFrame:
    return I.activity_events(L.events(spark, sf_dir), 7000).select("id", "activity_id", "event_type", "worker_id", "detail", "created_at")


@query(O.over("SELECT activity_id, split_part(step, ':', 1) AS kind, substr(step, strpos(step, ':') + 1) AS name, state, data, created_at FROM checkpoints WHERE owner_activity_id = 7000", O.RESULTS))
def activity_steps(spark, sf_dir) -> DataFrame:
    return I.activity_steps(L.results(spark, sf_dir), 7000)


@query(O.listing("parent_activity_id = 7000 AND queue_name = 'main'", "created_at, id"))
def children(spark, sf_dir) -> DataFrame:
    return I.children(L.activities(spark, sf_dir), MAIN, 7000)


@query(O.listing("queue_name = 'main' AND coalesce(root_activity_id, id) = (SELECT coalesce(root_activity_id, id) FROM snap WHERE id = 7002)", "depth, created_at, id", None))
def subtree(spark, sf_dir) -> DataFrame:
    return I.subtree(L.activities(spark, sf_dir), MAIN, 7002)


@query(O.over("SELECT queue_name, idempotency_key, activity_id FROM keys WHERE queue_name = 'main' AND idempotency_key = 'rq:step:7000:7000:s1'", O.KEYS))
def idempotency_lookup(spark, sf_dir) -> DataFrame:
    return I.key_lookup(L.idempotency(spark, sf_dir), MAIN, "rq:step:7000:7000:s1")


@query(O.over("SELECT parent_activity_id, id, split_part(idempotency_key, ':', 5) AS label FROM acts WHERE queue_name = 'main' AND starts_with(idempotency_key, 'rq:step:')"))
def step_edge_labels(spark, sf_dir) -> DataFrame:
    return I.step_edges(L.activities(spark, sf_dir), MAIN)


@query(O.over("SELECT coalesce(root_activity_id, id) AS root_id, count(*) AS n, count(*) FILTER (status NOT IN ('completed', 'failed', 'dead_letter')) AS n_open, max(depth)::INTEGER AS depth FROM acts WHERE queue_name = 'main' GROUP BY 1"))
def tree_sizes(spark, sf_dir) -> DataFrame:
    return I.tree_sizes(L.activities(spark, sf_dir), MAIN)


@query("WITH " + O.EVENTS + "SELECT id, activity_id, event_type, created_at FROM log WHERE id > 9000 ORDER BY id LIMIT 500")
def event_tail(spark, sf_dir) -> DataFrame:
    from tidemark.streaming.events import tail

    return tail(L.events(spark, sf_dir), 9000).select("id", "activity_id", "event_type", "created_at")


# --- transitions ----------------------------------------------------------------------------


def _requests(spark, sf_dir) -> DataFrame:
    """New activities asked for: one per customer, with options left out by turns."""
    c, k = L.read(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(k.alias("id"), F.lit(MAIN).alias("queue_name"), F.concat(F.lit("mail_"), F.lower("c_mktsegment")).alias("activity_type"), F.concat(F.lit('{"c":'), k.cast("string"), F.lit("}")).alias("payload"), F.when(k % 2 == 0, (1 + k % 4).cast("int")).alias("priority"), F.when(k % 3 == 0, (k % 7).cast("int")).alias("max_retries"), F.when(k % 5 == 0, k % 100).alias("delay_seconds"))


_REQUESTS = f"""
req AS (
  SELECT c_custkey AS id, 'main' AS queue_name, 'mail_' || lower(c_mktsegment) AS activity_type, '{{"c":' || c_custkey || '}}' AS payload,
    (CASE WHEN c_custkey % 2 = 0 THEN 1 + c_custkey % 4 ELSE 2 END)::INTEGER AS priority, (CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 7 ELSE 3 END)::INTEGER AS max_retries,
    300::BIGINT AS timeout_seconds, 1::BIGINT AS retry_delay_seconds, 3600::BIGINT AS max_retry_delay_seconds, {O.AS_OF} AS created_at,
    CASE WHEN c_custkey % 5 = 0 THEN {O.AS_OF} + to_seconds(c_custkey % 100) END AS scheduled_at, CASE WHEN c_custkey % 5 = 0 THEN 'scheduled' ELSE 'pending' END AS status,
    0 AS retry_count, NULL::BIGINT AS parent_activity_id, c_custkey AS root_activity_id, 0 AS depth
  FROM customer
)"""


@query("WITH " + _REQUESTS + "SELECT * FROM req")
def enqueue_defaults(spark, sf_dir) -> DataFrame:
    return T.new_activities(_requests(spark, sf_dir), L.as_of())


@query("WITH " + _REQUESTS + "SELECT id, status, CASE WHEN scheduled_at IS NULL THEN 'Enqueued' ELSE 'Scheduled' END AS event_type, '{\"activity_type\":' || to_json(activity_type)::VARCHAR || ',\"priority\":' || priority || CASE WHEN scheduled_at IS NULL THEN '' ELSE ',\"scheduled_at\":\"' || strftime(scheduled_at, '%Y-%m-%dT%H:%M:%S.000') || '\"' END || '}' AS detail FROM req")
def enqueue(spark, sf_dir) -> DataFrame:
    return T.enqueue(T.new_activities(_requests(spark, sf_dir), L.as_of()))


def _claims(spark, sf_dir) -> DataFrame:
    """Two claims of every root's key and two of a fresh one."""
    keyed = L.roots(spark, sf_dir).filter("idempotency_key IS NOT NULL").select("queue_name", "idempotency_key", "id", "created_at")
    fresh = keyed.withColumn("idempotency_key", F.concat(F.lit("new-"), "idempotency_key"))
    both = keyed.unionByName(fresh)
    return both.withColumn("id", F.col("id") * 10 + 1).unionByName(both.withColumn("id", F.col("id") * 10 + 2))


_CLAIMS = """
claims AS (
  SELECT queue_name, p.x || idempotency_key AS idempotency_key, id * 10 + t.y AS id, t.y AS turn, p.x = 'new-' AS fresh, k % 50 = 0 AND k <> 0 AS orphan, status, id AS held
  FROM acts, (VALUES (''), ('new-')) p(x), (VALUES (1), (2)) t(y) WHERE depth = 0 AND idempotency_key IS NOT NULL
)"""
_TAKEN = {
    "return_existing": ("'return'", "'return'"),
    "allow_reuse": ("'reuse'", "'reuse'"),
    "allow_reuse_on_failure": ("CASE WHEN status IN ('failed', 'dead_letter') THEN 'reuse' ELSE 'conflict' END", "'conflict'"),
    "no_reuse": ("'duplicate'", "'duplicate'"),
}
for _behaviour, (_held, _late) in _TAKEN.items():
    _sql = f"""
SELECT queue_name, idempotency_key, id, action,
  CASE WHEN action IN ('enqueue', 'reclaim', 'reuse') THEN id WHEN action = 'return' THEN CASE WHEN fresh OR orphan THEN held * 10 + 1 ELSE held END END AS activity_id
FROM (SELECT *, CASE WHEN turn = 1 THEN first WHEN first IN ('enqueue', 'reclaim', 'reuse') THEN {_late} ELSE first END AS action
      FROM (SELECT *, CASE WHEN fresh THEN 'enqueue' WHEN orphan THEN 'reclaim' ELSE {_held} END AS first FROM claims))"""
    query(O.over(_sql, _CLAIMS), f"idempotent_resolve_{_behaviour}")(lambda spark, sf_dir, b=_behaviour: T.resolve_keys(_claims(spark, sf_dir), L.idempotency(spark, sf_dir), L.activities(spark, sf_dir), b, L.partitions(spark, sf_dir)))


@query(O.over("SELECT queue_name, idempotency_key, activity_id FROM keys WHERE activity_id < 0", O.KEYS))
def idempotent_orphans(spark, sf_dir) -> DataFrame:
    return T.orphan_keys(L.idempotency(spark, sf_dir), L.activities(spark, sf_dir))


_ELIGIBLE = f"(status = 'pending' OR (status IN ('scheduled', 'retrying', 'waiting') AND scheduled_at <= {O.AS_OF}))"
_CLAIM_ORDER = "priority DESC, retry_count DESC, coalesce(scheduled_at, created_at) ASC NULLS LAST, id"
_LEASE = f"epoch_ms({O.AS_OF}) + greatest(60000, (timeout_seconds + 10) * 1000)"


def _claim_sql(more="", limit=500):
    return O.over(f"""
SELECT id, queue_name, activity_type, priority::INTEGER AS priority, retry_count, 'processing' AS status, 'me' AS current_worker_id, {O.AS_OF} AS started_at, {_LEASE} AS lease_deadline_ms, 'Dequeued' AS event_type
FROM acts WHERE queue_name = 'main' AND {_ELIGIBLE}{more} ORDER BY {_CLAIM_ORDER} LIMIT {limit}""")


def _claim(spark, sf_dir, slots=500, types=None):
    return T.claim(L.activities(spark, sf_dir), MAIN, slots, "me", L.as_of(), L.LEASE_MS, types)


@query(_claim_sql())
def claim_top_n(spark, sf_dir) -> DataFrame:
    return _claim(spark, sf_dir)


@query(_claim_sql(" AND activity_type = 'line_N'", 50))
def claim_one_type(spark, sf_dir) -> DataFrame:
    return _claim(spark, sf_dir, 50, ["line_N"])


@query(_claim_sql(" AND activity_type IN ('order_1', 'order_2', 'line_A')", 50))
def claim_many_types(spark, sf_dir) -> DataFrame:
    return _claim(spark, sf_dir, 50, ["order_1", "order_2", "line_A"])


@query(O.over(f"SELECT id, timeout_seconds, {_LEASE} AS lease_deadline_ms FROM acts WHERE {_ELIGIBLE}"))
def claim_lease(spark, sf_dir) -> DataFrame:
    found = T.eligible(L.activities(spark, sf_dir), L.as_of())
    return found.select("id", "timeout_seconds", S.lease_deadline_ms(S.epoch_ms(L.as_of()), "timeout_seconds", L.LEASE_MS).alias("lease_deadline_ms"))


@query(O.over(f"""
SELECT id, queue_name, activity_type, priority::INTEGER AS priority, retry_count, 'processing' AS status, 'w-' || queue_name AS current_worker_id, {O.AS_OF} AS started_at, {_LEASE} AS lease_deadline_ms, 'Dequeued' AS event_type
FROM (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY {_CLAIM_ORDER}) AS turn FROM acts WHERE {_ELIGIBLE}) WHERE turn <= CASE queue_name WHEN 'main' THEN 300 ELSE 20 END"""))
def claim_all_queues(spark, sf_dir) -> DataFrame:
    slots = spark.createDataFrame([("main", "w-main", 300), ("other", "w-other", 20)], "queue_name string, worker_id string, slots int")
    return T.claim_all_queues(L.activities(spark, sf_dir), slots, L.as_of(), L.LEASE_MS)


@query(O.over(f"SELECT id, 'completed' AS status, {O.AS_OF} AS completed_at, current_worker_id AS last_worker_id, 'Ok' AS state, given AS data, 'Completed' AS event_type, parent_activity_id FROM fenced WHERE outcome = 'success'", O.COMMANDS))
def ack_success(spark, sf_dir) -> DataFrame:
    return T.ack_success(L.activities(spark, sf_dir), L.commands(spark, sf_dir), L.as_of(), L.partitions(spark, sf_dir))


@query(O.over(f"""
SELECT id, status, CASE WHEN retry THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN retry THEN {O.AS_OF} + to_seconds({O.DELAY}) END AS scheduled_at,
  CASE WHEN NOT retry THEN {O.AS_OF} END AS completed_at, CASE WHEN NOT retry THEN started_at END AS started_at, error AS last_error, {O.AS_OF} AS last_error_at, current_worker_id AS last_worker_id,
  CASE WHEN NOT retry THEN 'Err' END AS state, CASE WHEN NOT retry THEN '{{"error":' || to_json(error)::VARCHAR || ',"type":"' || CASE outcome WHEN 'retryable' THEN 'dead_letter' ELSE 'non_retryable' END || '","failed_at":"1999-01-01T00:00:00Z"}}' END AS data,
  CASE status WHEN 'failed' THEN 'Failed' WHEN 'retrying' THEN 'Retrying' ELSE 'DeadLetter' END AS event_type, CASE WHEN NOT retry THEN parent_activity_id END AS wakes
FROM (SELECT * EXCLUDE status, outcome = 'retryable' AND {O.RETRY} AS retry, CASE WHEN outcome = 'non_retryable' THEN 'failed' WHEN {O.RETRY} THEN 'retrying' ELSE 'dead_letter' END AS status FROM fenced WHERE outcome <> 'success')""", O.COMMANDS))
def ack_failure_route(spark, sf_dir) -> DataFrame:
    return T.ack_failure(L.activities(spark, sf_dir), L.commands(spark, sf_dir), L.as_of(), L.partitions(spark, sf_dir))


@query(O.over(f"SELECT id, {O.DELAY} AS delay_seconds, {O.RETRY} AS again FROM acts"))
def retry_backoff(spark, sf_dir) -> DataFrame:
    return L.activities(spark, sf_dir).select("id", S.retry_delay_seconds("retry_delay_seconds", "retry_count", "max_retry_delay_seconds").alias("delay_seconds"), S.can_retry("retry_count", "max_retries").alias("again"))


def _reap_sql(more, cut):
    return O.over(f"""
SELECT id, CASE WHEN {O.RETRY} THEN 'pending' ELSE 'dead_letter' END AS status, retry_count + 1 AS retry_count, CASE WHEN NOT {O.RETRY} THEN {O.AS_OF} END AS completed_at, current_worker_id AS last_worker_id,
  CASE WHEN {O.RETRY} THEN 'Requeued' ELSE 'DeadLetter' END AS event_type, CASE WHEN NOT {O.RETRY} THEN 'Err' END AS state, CASE WHEN NOT {O.RETRY} THEN parent_activity_id END AS wakes
FROM acts WHERE status = 'processing' AND lease_deadline_ms < epoch_ms({O.AS_OF}){more}{cut}""")


@query(_reap_sql("", " ORDER BY id LIMIT 100"))
def reap_expired(spark, sf_dir) -> DataFrame:
    return T.reap(L.activities(spark, sf_dir), L.as_of(), 100)


@query(_reap_sql(f" AND NOT {O.RETRY}", ""))
def reap_dead_letters(spark, sf_dir) -> DataFrame:
    return T.reap(L.activities(spark, sf_dir), L.as_of(), None).filter("status = 'dead_letter'")


@query(O.over(f"""
SELECT id, 'waiting' AS status, {O.AS_OF} + to_seconds(h % 600) AS scheduled_at, retry_count, NULL::TIMESTAMP AS started_at, NULL::BIGINT AS lease_deadline_ms, current_worker_id AS last_worker_id, 'Yielded' AS event_type,
  '{{"kind":"sleep","step":"s' || (h % 3) || '"}}' AS detail FROM fenced""", O.COMMANDS))
def yield_park(spark, sf_dir) -> DataFrame:
    h = F.col("id") % 1000 + F.floor(F.col("id") / 1000)
    yields = L.commands(spark, sf_dir).select("id", "worker_id", S.plus_seconds(L.as_of(), h % 600).alias("wake_at"), F.lit("sleep").alias("kind"), F.concat(F.lit("s"), (h % 3).cast("string")).alias("step"))
    return T.park(L.activities(spark, sf_dir), yields, L.partitions(spark, sf_dir))


@query(O.over("SELECT id, 'pending' AS status, NULL::TIMESTAMP AS scheduled_at FROM acts WHERE status = 'waiting' AND id IN (SELECT parent_activity_id FROM acts WHERE status IN ('completed', 'failed', 'dead_letter'))"))
def wake_parents(spark, sf_dir) -> DataFrame:
    ended = L.children(spark, sf_dir).filter(F.col("status").isin(S.TERMINAL))
    return T.wake_parents(L.activities(spark, sf_dir), ended)


@query(O.over("""
SELECT event_id AS signal_id, user_id * 997 AS id, a.id IS NOT NULL AS delivered, coalesce(status = 'waiting', false) AS woke, CASE WHEN a.id IS NOT NULL THEN 'signal:' || event_type END AS step,
  CASE WHEN a.id IS NOT NULL THEN props END AS data, CASE WHEN a.id IS NOT NULL THEN 'Signaled' END AS event_type FROM events LEFT JOIN acts a ON user_id * 997 = a.id"""))
def signal_deliver(spark, sf_dir) -> DataFrame:
    signals = L.read(spark, sf_dir, "events").select(F.col("event_id").alias("signal_id"), (F.col("user_id") * 997).alias("id"), F.col("event_type").alias("name"), F.col("props").alias("payload"))
    return T.signal(L.activities(spark, sf_dir), signals)


@query(O.over("""
SELECT r.id AS signal_id, r.activity_id AS id, r.a IS NOT NULL AS delivered, coalesce(r.st = 'waiting', false) AS woke, CASE WHEN r.a IS NOT NULL THEN 'signal:go' END AS step, CASE WHEN r.a IS NOT NULL THEN '{}' END AS data, CASE WHEN r.a IS NOT NULL THEN 'Signaled' END AS event_type
FROM (SELECT s.id, keys.activity_id, a.id AS a, a.status AS st FROM acts s LEFT JOIN keys ON keys.queue_name = s.queue_name AND keys.idempotency_key = 'ord-' || s.k || '-' || s.activity_type LEFT JOIN acts a ON a.id = keys.activity_id WHERE s.depth = 0) r""", O.KEYS))
def signal_by_key(spark, sf_dir) -> DataFrame:
    signals = L.roots(spark, sf_dir).select("queue_name", "activity_type", F.concat(F.lit("ord-"), F.floor(F.col("id") / 1000).cast("string")).alias("key"), F.lit("go").alias("name"), F.col("id").alias("signal_id"), F.lit("{}").alias("payload"))
    return T.signal_by_key(L.activities(spark, sf_dir), L.idempotency(spark, sf_dir), signals)


@query("SELECT user_id AS activity_id, arg_max(event_type, event_id) AS state, arg_max(props, event_id) AS data, user_id * 1000 AS owner_activity_id, 'run:x' AS step FROM events GROUP BY user_id")
def results_latest(spark, sf_dir) -> DataFrame:
    stored = L.read(spark, sf_dir, "events").select(F.col("user_id").alias("activity_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("state"), F.col("props").alias("data"), (F.col("user_id") * 1000).alias("owner_activity_id"), F.lit("run:x").alias("step"))
    return T.latest_results(stored)


@query(O.over(f"SELECT id, epoch_ms({O.AS_OF}) + 600 * (h % 5) * 1000 AS lease_deadline_ms, 'LeaseExtended' AS event_type FROM acts WHERE status = 'processing'"))
def extend_lease(spark, sf_dir) -> DataFrame:
    h = F.col("id") % 1000 + F.floor(F.col("id") / 1000)
    return T.extend_lease(L.activities(spark, sf_dir), L.activities(spark, sf_dir).select("id", (600 * (h % 5)).alias("by_seconds")), L.as_of())


@query(O.over("SELECT id AS child_id, CASE WHEN k % 3 = 0 THEN k * 1000 ELSE (k + 1) * 1000 END AS parent_id, 'SpawnLinked' AS event_type FROM acts WHERE depth = 1 AND k % 3 <> 0"))
def spawn_links(spark, sf_dir) -> DataFrame:
    k = F.floor(F.col("id") / 1000)
    resolved = L.children(spark, sf_dir).select(F.col("id").alias("child_id"), F.when(k % 3 == 0, k * 1000).otherwise((k + 1) * 1000).alias("parent_id"))
    return T.spawn_links(resolved, L.activities(spark, sf_dir))


@query(O.over("SELECT id AS caller, id AS parent_activity_id, coalesce(root_activity_id, id) AS root_activity_id, (depth + 1)::INTEGER AS depth FROM acts"))
def spawn_lineage(spark, sf_dir) -> DataFrame:
    return T.spawn(L.activities(spark, sf_dir))


@query(O.over("SELECT id AS caller, id AS parent_activity_id, coalesce(root_activity_id, id) AS root_activity_id, (depth + k % 40 + 1)::INTEGER AS depth FROM acts WHERE depth + k % 40 + 1 > 32"))
def depth_violations(spark, sf_dir) -> DataFrame:
    deep = L.activities(spark, sf_dir).withColumn("depth", (F.col("depth") + F.floor(F.col("id") / 1000) % 40).cast("int"))
    return T.depth_violations(T.spawn(deep))


@query(O.over("SELECT id, 'rq:step:' || coalesce(root_activity_id, id) || ':' || id || ':next' AS step_key FROM acts"))
def step_keys(spark, sf_dir) -> DataFrame:
    return L.activities(spark, sf_dir).select("id", S.step_key(F.coalesce("root_activity_id", "id"), F.col("id"), F.lit("next")).alias("step_key"))


@query("SELECT p_partkey, p_name AS name, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]{0,47}$') AS valid, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z_][A-Za-z0-9_]{0,47}$') AS valid_joined FROM part")
def valid_queue_names(spark, sf_dir) -> DataFrame:
    return L.read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), S.valid_queue_name("p_name").alias("valid"), S.valid_queue_name(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("valid_joined"))


@query("""
WITH named AS (
  SELECT c_custkey, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode('run:' || c_name)) AS d FROM customer
)
SELECT c_custkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(d, 17, 1)) - 1) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM named""")
def checkpoint_ids(spark, sf_dir) -> DataFrame:
    return L.read(spark, sf_dir, "customer").select("c_custkey", S.checkpoint_id(F.lit("6ba7b810-9dad-11d1-80b4-00c04fd430c8"), F.concat(F.lit("run:"), "c_name")).alias("id"))


_SWEEP = f"""
going AS (SELECT DISTINCT coalesce(root_activity_id, id) AS root FROM acts WHERE queue_name = 'main' AND status NOT IN ('completed', 'failed', 'dead_letter')),
gone AS (
  SELECT id, completed_at FROM acts WHERE queue_name = 'main' AND parent_activity_id IS NULL AND NOT EXISTS (SELECT 1 FROM going WHERE root = acts.id)
    AND ((status = 'completed' AND completed_at < {O.AS_OF} - INTERVAL 30 DAY) OR (status IN ('failed', 'dead_letter') AND completed_at < {O.AS_OF} - INTERVAL 60 DAY))
)"""
DAY = 86400


def _gone(spark, sf_dir, batch=None):
    return T.expired_roots(L.activities(spark, sf_dir), MAIN, L.as_of(), 30 * DAY, 60 * DAY, batch, L.partitions(spark, sf_dir))


@query(O.over("SELECT id, completed_at FROM gone ORDER BY completed_at, id LIMIT 100", _SWEEP))
def sweep_roots(spark, sf_dir) -> DataFrame:
    return _gone(spark, sf_dir, 100)


@query(O.over("""
SELECT 'activities' AS kind, count(*) AS n FROM acts WHERE coalesce(root_activity_id, id) IN (SELECT id FROM gone)
UNION ALL SELECT 'results', count(*) FROM doomed
UNION ALL SELECT 'events', count(*) FROM log WHERE activity_id IN (SELECT id FROM tree UNION ALL SELECT activity_id FROM doomed)
UNION ALL SELECT 'keys', count(*) FROM keys WHERE activity_id IN (SELECT id FROM tree)""", _SWEEP, O.RESULTS, O.KEYS, O.EVENTS, """
tree AS (SELECT id FROM acts WHERE coalesce(root_activity_id, id) IN (SELECT id FROM gone)),
doomed AS (SELECT activity_id FROM results WHERE owner_activity_id IN (SELECT id FROM tree) OR activity_id IN (SELECT id FROM tree))"""))
def sweep_tree_counts(spark, sf_dir) -> DataFrame:
    tables = {"activities": L.activities(spark, sf_dir), "results": L.results(spark, sf_dir), "events": L.events(spark, sf_dir), "keys": L.idempotency(spark, sf_dir)}
    kinds = spark.createDataFrame([(kind, 0) for kind in tables], "kind string, n long")
    for kind, gone in T.sweep(tables, _gone(spark, sf_dir), L.partitions(spark, sf_dir)).items():
        kinds = kinds.unionByName(gone.select(F.lit(kind).alias("kind"), F.lit(1).alias("n")))
    return kinds.groupBy("kind").agg(F.sum("n").alias("n"))


# --- time: timers, leases, fences, commits ----------------------------------------------------

#: Events end on 2024-01-30; timers are asked for five days before.
_TIMERS_AT = "2024-01-25 00:00:00"


def _timer_commands(spark, sf_dir, timer, ops, minutes) -> DataFrame:
    """Commands of one timer of each user, read from what events do to an activity."""
    e, n = L.read(spark, sf_dir, "events"), F.col("event_id")
    case = lambda k: F.create_map(*[F.lit(x) for event, pair in ops.items() for x in (event, pair[k])])[F.col("event_type")]
    at = S.epoch_ms(F.col("ts"))
    armed = case(0) != "cancel"
    return e.select(
        (F.col("user_id") * 1000).cast("string").alias("activity_id"), F.lit(timer).alias("timer"), case(0).alias("op"), F.when(armed, case(1)).alias("kind"),
        F.when(armed, at + 60_000 * (n * minutes[0] % minutes[1])).alias("due_ms"), (n % 5).cast("int").alias("attempt"), at.alias("at_ms"), n.alias("seq"),
    )


_WAKES = {"click": ("set", "sleep"), "error": ("set", "retry"), "signup": ("set", "delay"), "view": ("cancel", ""), "purchase": ("cancel", "")}
_LEASES = {"view": ("set", "lease"), "click": ("extend", "lease"), "signup": ("extend", "lease"), "error": ("cancel", ""), "purchase": ("cancel", "")}


def _timer_sql(timer, ops, minutes):
    """Played forward by recursion over each activity's commands: what is armed before each, and whether its time passes first."""
    case = lambda k: "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{p[k]}'" for e, p in ops.items()) + " END"
    return f"""
WITH RECURSIVE cmd AS (
  SELECT (user_id * 1000)::VARCHAR AS activity_id, {case(0)} AS op, {case(1)} AS kind, epoch_us(ts) // 1000 AS at_ms, epoch_us(ts) // 1000 + 60000 * (event_id * {minutes[0]} % {minutes[1]}) AS due, (event_id % 5)::INTEGER AS attempt, event_id AS seq,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events
), closed AS (
  SELECT * FROM cmd UNION ALL SELECT activity_id, 'cancel', '', 9223372036854775807, 0, 0, -1, max(n) + 1 FROM cmd GROUP BY activity_id
), play AS (
  SELECT activity_id, n, CASE WHEN op = 'set' THEN due END AS due, CASE WHEN op = 'set' THEN at_ms END AS armed_ms, kind, attempt, seq, NULL::BIGINT AS fired_ms, NULL::BIGINT AS fired_due, NULL::VARCHAR AS fired_kind, NULL::INTEGER AS fired_attempt, NULL::BIGINT AS fired_seq
  FROM closed WHERE n = 1
  UNION ALL
  SELECT c.activity_id, c.n, CASE WHEN c.op = 'set' OR (c.op = 'extend' AND p.due IS NOT NULL AND greatest(p.due, p.armed_ms) >= c.at_ms) THEN c.due END, c.at_ms, c.kind, c.attempt, c.seq,
    CASE WHEN greatest(p.due, p.armed_ms) < c.at_ms AND p.due IS NOT NULL THEN greatest(p.due, p.armed_ms) END, p.due, p.kind, p.attempt, p.seq
  FROM play p JOIN closed c ON c.activity_id = p.activity_id AND c.n = p.n + 1
)
SELECT activity_id, '{timer}' AS timer, fired_kind AS kind, fired_due AS due_ms, fired_attempt AS attempt, fired_ms, fired_seq AS seq FROM play WHERE fired_ms <= epoch_ms(TIMESTAMP '{_TIMERS_AT}')"""


def _timers_at():
    return S.epoch_ms(F.lit(_TIMERS_AT).cast("timestamp_ntz"))


@query(_timer_sql("wake", _WAKES, (37, 1500)))
def due_timers(spark, sf_dir) -> DataFrame:
    """Sleeps, retries and delays as they fell due."""
    return timers.fired(_timer_commands(spark, sf_dir, "wake", _WAKES, (37, 1500)), _timers_at())


@query(_timer_sql("lease", _LEASES, (53, 1200)))
def lease_expiries(spark, sf_dir) -> DataFrame:
    """Leases that ended, each at the deadline that it was last moved to."""
    return timers.fired(_timer_commands(spark, sf_dir, "lease", _LEASES, (53, 1200)), _timers_at())


def _attempts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Activities with the attempt of their claim, and acknowledgements: of it, of earlier and later ones, by others, of what isn't in process, and repeated."""
    a = L.activities(spark, sf_dir).withColumn("attempt", F.col("retry_count") + 1)
    h = F.col("id") % 1000 + F.floor(F.col("id") / 1000)
    sent = a.filter((F.col("status") == "processing") | (h % 50 == 0)).select(
        F.when(h % 101 == 0, -F.col("id")).otherwise(F.col("id")).alias("id"), F.when(h % 11 == 0, "stale").otherwise(F.coalesce("current_worker_id", F.lit("w0"))).alias("worker_id"),
        F.when(h % 5 == 0, F.col("attempt") - 1).when(h % 7 == 0, F.col("attempt") + 1).when(h % 13 != 0, F.col("attempt")).alias("attempt"),
        F.lit("success").alias("outcome"), F.concat(F.lit('{"n":'), h.cast("string"), F.lit("}")).alias("data"), F.lit(None).cast("string").alias("error"), (2 * F.col("id")).alias("seq"),
    )
    again = sent.filter(F.pmod(F.col("id"), F.lit(3)) == 0).withColumns({"seq": F.col("seq") + 1, "data": F.lit("again")})
    return a, sent.unionByName(again)


_ATTEMPTS = """
sent AS (
  SELECT CASE WHEN h % 101 = 0 THEN -id ELSE id END AS id, CASE WHEN h % 11 = 0 THEN 'stale' ELSE coalesce(current_worker_id, 'w0') END AS worker_id,
    CASE WHEN h % 5 = 0 THEN retry_count WHEN h % 7 = 0 THEN retry_count + 2 WHEN h % 13 <> 0 THEN retry_count + 1 END AS attempt, '{"n":' || h || '}' AS given, 2 * id AS seq
  FROM acts WHERE status = 'processing' OR h % 50 = 0
), acks AS (
  SELECT *, 1 AS turn FROM sent UNION ALL SELECT id, worker_id, attempt, 'again', seq + 1, 2 FROM sent WHERE id % 3 = 0
), judged AS (
  SELECT acks.*, parent_activity_id, CASE WHEN acts.id IS NULL THEN 'unknown' WHEN status <> 'processing' THEN 'ended' WHEN worker_id <> current_worker_id THEN 'foreign'
    WHEN attempt IS NULL OR attempt < retry_count + 1 THEN 'late' WHEN attempt > retry_count + 1 THEN 'early' WHEN turn > 1 THEN 'repeated' END AS reason
  FROM acks LEFT JOIN acts ON acts.id = acks.id
)"""


@query(O.over("SELECT id, worker_id, attempt::INTEGER AS attempt, seq, reason FROM judged WHERE reason IS NOT NULL", _ATTEMPTS))
def stale_acks(spark, sf_dir) -> DataFrame:
    return T.stale_acks(*_attempts(spark, sf_dir))


@query(O.over(f"SELECT id, 'completed' AS status, {O.AS_OF} AS completed_at, worker_id AS last_worker_id, 'Ok' AS state, given AS data, 'Completed' AS event_type, parent_activity_id FROM judged WHERE reason IS NULL", _ATTEMPTS))
def ack_success_by_attempt(spark, sf_dir) -> DataFrame:
    a, sent = _attempts(spark, sf_dir)
    return T.ack_success(a, sent, L.as_of(), L.partitions(spark, sf_dir))


@query("SELECT event_id % 8 + 1 AS number, (user_id * 1000)::VARCHAR AS activity_id, event_type AS kind, event_id::VARCHAR AS detail, ts AS created_at FROM events WHERE event_id % 8 IN (2, 3, 4) UNION ALL SELECT 6, (user_id * 1000)::VARCHAR, event_type, event_id::VARCHAR, ts FROM events WHERE event_id % 8 = 6")
def events_by_commit(spark, sf_dir) -> DataFrame:
    """Events of the commits after 2 and up to 6, of a log of seven commits and a batch, the sixth, that was cut off before its own."""
    found = commits.between(spark, L.event_log(spark, sf_dir), "events", after=2, upto=6)
    return found.select("number", "activity_id", F.col("event_type").alias("kind"), "detail", "created_at")


# --- counters and metadata --------------------------------------------------------------------


def _outcomes(spark, sf_dir) -> DataFrame:
    """Commands, some of them waits and some of them timeouts."""
    h = F.col("id") % 1000 + F.floor(F.col("id") / 1000)
    c = L.commands(spark, sf_dir)
    return c.select("id", "worker_id", F.when(h % 9 == 0, "yield").otherwise(F.col("outcome")).alias("outcome"), F.when(h % 6 == 2, T.TIMEOUT).otherwise(F.col("error")).alias("error"))


@query(O.over("""
SELECT name AS counter, count(*) FILTER (counter = name)::BIGINT AS value FROM (SELECT unnest(['activity_completed', 'activity_lost_completion', 'activity_yielded', 'activity_retry', 'activity_failed_non_retry', 'activity_timeout', 'activity_trees_swept']) AS name), (
  SELECT CASE WHEN h % 9 = 0 THEN CASE WHEN worker = current_worker_id THEN 'activity_yielded' END WHEN outcome = 'success' THEN CASE WHEN worker = current_worker_id THEN 'activity_completed' ELSE 'activity_lost_completion' END
    WHEN outcome = 'non_retryable' THEN 'activity_failed_non_retry' WHEN h % 6 = 2 THEN 'activity_timeout' ELSE 'activity_retry' END AS counter FROM held
  UNION ALL SELECT 'activity_trees_swept' FROM gone) GROUP BY name""", O.COMMANDS, _SWEEP))
def metric_counters(spark, sf_dir) -> DataFrame:
    return T.counters(T.counted(L.activities(spark, sf_dir), _outcomes(spark, sf_dir), L.partitions(spark, sf_dir)), _gone(spark, sf_dir))


@query(O.over("""
SELECT id, CASE WHEN h % 7 = 2 AND k % 4 = 3 AND h % 2 = 1 THEN NULL ELSE array_to_string(list_sort(list_filter([
    'source=' || CASE WHEN k % 4 = 1 THEN 'again' WHEN k % 4 = 2 THEN 'null' WHEN h % 7 = 0 THEN 'cron' WHEN h % 7 = 1 THEN 'api' END,
    CASE WHEN k % 4 <> 3 THEN 'k=' || CASE WHEN h % 2 = 0 THEN 'last' ELSE k::VARCHAR END WHEN h % 2 = 0 THEN 'k=last' END], lambda x: x IS NOT NULL)), ',') END AS pairs FROM acts"""))
def merged_metadata(spark, sf_dir) -> DataFrame:
    """Metadata with two later maps over it: keys that come again, null values, null maps."""
    k, h = F.floor(F.col("id") / 1000), F.col("id") % 1000 + F.floor(F.col("id") / 1000)
    source = F.when(k % 4 == 1, '"source":"again",').when(k % 4 == 2, '"source":null,').otherwise("")
    second = F.when(k % 4 != 3, F.concat(F.lit("{"), source, F.lit('"k":"'), k.cast("string"), F.lit('"}')))
    merged = S.merged_metadata(F.array("metadata", second, F.when(h % 2 == 0, '{"k":"last"}')))
    pairs = F.transform(F.map_entries(F.from_json(merged, "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return L.activities(spark, sf_dir).select("id", F.array_join(F.array_sort(pairs), ",").alias("pairs"))
