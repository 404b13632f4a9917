"""The lift and its helpers as DuckDB SQL, written apart from the DataFrame code they check."""

AS_OF = "TIMESTAMP '1999-01-01 00:00:00'"

_FINISH = """
  SELECT id, queue_name, activity_type, '{"k":' || k || '}' AS payload, priority, status, created_at,
    CASE WHEN status IN ('scheduled', 'retrying', 'waiting') THEN created_at + INTERVAL 5 DAY END AS scheduled_at,
    CASE WHEN status = 'processing' OR terminal THEN created_at + INTERVAL 1 HOUR END AS started_at,
    CASE WHEN terminal AND h % 97 <> 0 THEN created_at + INTERVAL 2 DAY END AS completed_at,
    CASE WHEN status = 'processing' THEN epoch_ms(created_at + INTERVAL 1 HOUR) + greatest(60000, (60 * (1 + h % 10) + 10) * 1000) END AS lease_deadline_ms,
    CASE WHEN status = 'processing' THEN 'w' || (w % 50) END AS current_worker_id,
    CASE WHEN terminal OR status = 'retrying' THEN 'w' || (w % 50) END AS last_worker_id,
    (h % 4)::INTEGER AS retry_count, (h % 6)::INTEGER AS max_retries, (60 * (1 + h % 10))::BIGINT AS timeout_seconds, (h % 4)::BIGINT AS retry_delay_seconds,
    (CASE WHEN h % 3 = 0 THEN 0 ELSE 20 END)::BIGINT AS max_retry_delay_seconds,
    CASE WHEN status IN ('failed', 'dead_letter', 'retrying') THEN 'err' || (h % 5) END AS last_error,
    CASE WHEN status IN ('failed', 'dead_letter', 'retrying') THEN created_at + INTERVAL 36 HOUR END AS last_error_at,
    CASE h % 7 WHEN 0 THEN '{"source":"cron"}' WHEN 1 THEN '{"source":"api"}' WHEN 2 THEN NULL ELSE '{}' END AS metadata,
    CASE WHEN rn > 0 THEN 'rq:step:' || parent_activity_id || ':' || parent_activity_id || ':s' || rn
         WHEN h % 3 = 0 THEN 'ord-' || k || '-' || activity_type END AS idempotency_key,
    parent_activity_id, root_activity_id, depth, h, k
  FROM (SELECT *, id % 1000 + k AS h, status IN ('completed', 'failed', 'dead_letter') AS terminal FROM base)
"""

LIFT = f"""
line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem
), base AS (
  SELECT o_orderkey * 1000 AS id, o_orderkey AS k, 0 AS rn, o_custkey AS w, CASE WHEN o_custkey % 10 = 0 THEN 'other' ELSE 'main' END AS queue_name,
    'order_' || substr(o_orderpriority, 1, 1) AS activity_type,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '5' THEN 1 ELSE 2 END AS priority,
    CASE o_orderstatus WHEN 'F' THEN CASE o_orderkey % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'dead_letter' ELSE 'completed' END
      WHEN 'O' THEN CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'scheduled' WHEN 2 THEN 'retrying' ELSE 'waiting' END
      ELSE 'processing' END AS status,
    o_orderdate AS created_at, NULL::BIGINT AS parent_activity_id, CASE WHEN o_orderkey % 101 <> 0 THEN o_orderkey * 1000 END AS root_activity_id, 0 AS depth
  FROM orders
  UNION ALL
  SELECT l_orderkey * 1000 + rn, l_orderkey, rn, l_suppkey, CASE WHEN o_custkey % 10 = 0 THEN 'other' ELSE 'main' END, 'line_' || l_returnflag, 1 + l_linenumber % 4,
    CASE WHEN l_linestatus = 'F' OR (o_orderstatus = 'F' AND l_orderkey % 2 = 0)
      THEN CASE WHEN l_returnflag <> 'R' THEN 'completed' WHEN l_linenumber % 2 = 0 THEN 'failed' ELSE 'dead_letter' END
      ELSE CASE l_linenumber WHEN 1 THEN 'pending' WHEN 2 THEN 'scheduled' WHEN 3 THEN 'retrying' WHEN 4 THEN 'waiting' ELSE 'processing' END END,
    l_shipdate, l_orderkey * 1000, l_orderkey * 1000, 1
  FROM line JOIN orders ON l_orderkey = o_orderkey
), acts AS MATERIALIZED ({_FINISH})"""

SNAP = """
snap AS (
  SELECT id, queue_name, activity_type, payload, (CASE WHEN priority <= 1 THEN 1 WHEN priority > 4 THEN 2 ELSE priority END)::INTEGER AS priority,
    CASE status WHEN 'processing' THEN 'Running' WHEN 'dead_letter' THEN 'DeadLetter' WHEN 'pending' THEN 'Pending' WHEN 'scheduled' THEN 'Scheduled'
      WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' WHEN 'retrying' THEN 'Retrying' WHEN 'waiting' THEN 'Waiting' ELSE 'Pending' END AS label,
    status, created_at, scheduled_at, started_at, completed_at, coalesce(started_at, completed_at, created_at) AS status_updated_at, lease_deadline_ms, current_worker_id, last_worker_id,
    retry_count, max_retries, timeout_seconds, retry_delay_seconds, last_error, last_error_at, metadata, idempotency_key, parent_activity_id, root_activity_id, depth::INTEGER AS depth,
    coalesce(json_extract_string(metadata, '$.source') = 'cron', false) AS cron
  FROM acts
)"""

_COLUMNS = """id, queue_name, activity_type, payload, priority, label AS status, created_at, scheduled_at, started_at, completed_at, status_updated_at, lease_deadline_ms,
  current_worker_id, last_worker_id, retry_count, max_retries, timeout_seconds, retry_delay_seconds, last_error, last_error_at, metadata, idempotency_key, parent_activity_id, root_activity_id, depth"""

RESULTS = """
checkpoints AS (
  SELECT -id AS activity_id, 'Ok' AS state, payload AS data, created_at, root_activity_id AS owner_activity_id,
    CASE id % 1000 % 3 WHEN 0 THEN 'run' WHEN 1 THEN 'sleep' ELSE 'signal' END || ':s' || (id % 1000) AS step
  FROM acts WHERE depth = 1
), results AS (
  SELECT id AS activity_id, CASE WHEN status = 'completed' THEN 'Ok' ELSE 'Err' END AS state, payload AS data, created_at + INTERVAL 2 DAY AS created_at, id AS owner_activity_id, NULL AS step
  FROM acts WHERE status IN ('completed', 'failed', 'dead_letter')
  UNION ALL SELECT * FROM checkpoints
)"""

KEYS = """
keys AS (
  SELECT queue_name, idempotency_key, CASE WHEN k % 50 = 0 THEN -id ELSE id END AS activity_id, created_at FROM acts WHERE idempotency_key IS NOT NULL
)"""

EVENTS = """
log AS (
  SELECT event_id AS id, user_id * 1000 AS activity_id, 'main' AS queue_name,
    CASE event_type WHEN 'signup' THEN 'Enqueued' WHEN 'view' THEN 'Dequeued' WHEN 'click' THEN 'Yielded' WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE event_type END AS event_type,
    NULL::VARCHAR AS worker_id, props AS detail, ts AS created_at
  FROM events
)"""

COMMANDS = """
held AS (
  SELECT *, CASE WHEN h % 11 = 0 THEN 'stale' ELSE current_worker_id END AS worker, CASE h % 4 WHEN 0 THEN 'success' WHEN 1 THEN 'non_retryable' ELSE 'retryable' END AS outcome,
    CASE h % 3 WHEN 0 THEN 'bad "quote"' WHEN 1 THEN 'line' || chr(10) || 'and \\ slash' ELSE 'boom2' END AS error, '{"done":' || id || '}' AS given
  FROM acts WHERE status = 'processing'
), fenced AS (SELECT * FROM held WHERE worker = current_worker_id)"""

POOLS = f"""
pools AS (
  SELECT s_suppkey AS pool_id, 'main' AS queue_name, (1 + s_suppkey % 16)::INTEGER AS max_workers, {AS_OF} - to_seconds(s_suppkey % 120) AS last_seen_at FROM supplier
)"""

DELAY = """least(CASE WHEN max_retry_delay_seconds <= 0 THEN 3600 ELSE max_retry_delay_seconds END,
  CASE WHEN retry_delay_seconds <= 0 THEN 0 ELSE least(retry_delay_seconds::HUGEINT * (1::HUGEINT << least(retry_count + 1, 62)), 9223372036) END)::BIGINT"""

RETRY = "(max_retries = 0 OR retry_count + 1 < max_retries)"


def over(body: str, *parts: str) -> str:
    return "WITH " + ",".join([LIFT, *parts]) + "\n" + body


def listing(where: str, order: str, limit: int | None = 50, more: str = "") -> str:
    cut = f" LIMIT {limit}" if limit is not None else ""
    return over(f"SELECT {_COLUMNS}{more} FROM snap WHERE {where} ORDER BY {order}{cut}", SNAP)
