"""The queue's five tables, lifted from the star schema by fixed rules.

Every function takes (spark, sf_dir). Times have no zone and mean UTC.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S

AS_OF = "1999-01-01 00:00:00"
LEASE_MS = 60_000


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hours(n: int):
    return F.expr(f"INTERVAL '{n}' HOUR")


def _queue(customer):
    return F.when(customer % 10 == 0, "other").otherwise("main")


def finished(rows: DataFrame) -> DataFrame:
    """Activities from their rows: everything that follows from what `rows` gives."""
    df = rows.withColumn("k", F.expr("(id - rn) div 1000"))
    h, k, child = F.col("id") % 1000 + F.col("k"), F.col("k"), F.col("rn") > 0
    status, created = F.col("status"), F.col("created_at")
    terminal = status.isin(S.TERMINAL)
    worker = F.concat(F.lit("w"), (F.col("w") % 50).cast("string"))
    timeout = (60 * (1 + h % 10)).cast("long")
    started = F.when((status == "processing") | terminal, created + _hours(1))
    failing = status.isin("failed", "dead_letter", "retrying")
    root_key = F.when(h % 3 == 0, F.concat(F.lit("ord-"), k.cast("string"), F.lit("-"), F.col("activity_type")))
    step = S.step_key(k * 1000, k * 1000, F.concat(F.lit("s"), F.col("rn").cast("string")))
    return df.select(
        "id", "queue_name", "activity_type", F.concat(F.lit('{"k":'), k.cast("string"), F.lit("}")).alias("payload"), "priority", "status", "created_at",
        F.when(status.isin(S.DUE), created + _hours(120)).alias("scheduled_at"), started.alias("started_at"),
        F.when(terminal & (h % 97 != 0), created + _hours(48)).alias("completed_at"),
        F.when(status == "processing", S.lease_deadline_ms(S.epoch_ms(created + _hours(1)), timeout, LEASE_MS)).alias("lease_deadline_ms"),
        F.when(status == "processing", worker).alias("current_worker_id"), F.when(terminal | (status == "retrying"), worker).alias("last_worker_id"),
        (h % 4).cast("int").alias("retry_count"), (h % 6).cast("int").alias("max_retries"), timeout.alias("timeout_seconds"), (h % 4).cast("long").alias("retry_delay_seconds"),
        F.when(h % 3 == 0, 0).otherwise(20).cast("long").alias("max_retry_delay_seconds"),
        F.when(failing, F.concat(F.lit("err"), (h % 5).cast("string"))).alias("last_error"), F.when(failing, created + _hours(36)).alias("last_error_at"),
        F.when(h % 7 == 0, '{"source":"cron"}').when(h % 7 == 1, '{"source":"api"}').when(h % 7 == 2, F.lit(None)).otherwise("{}").alias("metadata"),
        F.when(child, step).otherwise(root_key).alias("idempotency_key"), F.when(child, k * 1000).alias("parent_activity_id"), F.when(child | (k % 101 != 0), k * 1000).alias("root_activity_id"), F.when(child, 1).otherwise(0).alias("depth"),
    )


def rows(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """One row per order and per line, in the few columns that all others follow from: id, rn (0: order), w, queue_name, activity_type, priority, status, created_at.

    One shuffle: orders and lines are dealt together into ``parts`` ranges of the order key, where a window numbers the lines and gives
    them what they take from their order. A line is as many rows as its key has orders; without one, none.
    """
    none, parts = F.lit(None), parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    orders = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.lit(False).alias("line"), none.alias("n"), none.alias("part"), F.col("o_custkey").alias("w"), none.alias("price"), F.col("o_orderdate").alias("created_at"), F.substring("o_orderpriority", 1, 1).alias("flag"), F.col("o_orderstatus").alias("state"),
    )
    lines = read(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL").select(
        F.col("l_orderkey").alias("k"), F.lit(True).alias("line"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("w"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("created_at"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("state"),
    )
    k, n, line, flag, state = (F.col(c) for c in ("k", "n", "line", "flag", "state"))
    order = Window.partitionBy("k").orderBy("line", "n", "part", "w", "price", "created_at")
    head = F.struct(F.col("w").alias("customer"), state.alias("o_state"))
    heads = F.collect_list(F.when(~line & k.isNotNull(), head)).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    found = orders.unionByName(lines).repartitionByRange(parts, "k").withColumns({"turn": F.row_number().over(order), "heads": heads})
    found = found.select("*", F.inline(F.when(line, F.col("heads")).otherwise(F.array(head))))
    rn = F.when(line, F.col("turn") - F.size("heads")).otherwise(0)
    failed = F.when(k % 10 == 0, "failed").when(k % 10 == 1, "dead_letter").otherwise("completed")
    waiting = F.when(k % 4 == 0, "pending").when(k % 4 == 1, "scheduled").when(k % 4 == 2, "retrying").otherwise("waiting")
    root = F.when(F.col("o_state") == "F", failed).when(F.col("o_state") == "O", waiting).otherwise("processing")
    over = (state == "F") | ((F.col("o_state") == "F") & (k % 2 == 0))
    ended = F.when(flag != "R", "completed").when(n % 2 == 0, "failed").otherwise("dead_letter")
    going = F.when(n == 1, "pending").when(n == 2, "scheduled").when(n == 3, "retrying").when(n == 4, "waiting").otherwise("processing")
    return found.select(
        (k * 1000 + rn).alias("id"), rn.alias("rn"), "w", _queue(F.col("customer")).alias("queue_name"), F.concat(F.when(line, "line_").otherwise("order_"), flag).alias("activity_type"),
        F.when(line, 1 + n % 4).when(flag == "1", 4).when(flag == "2", 3).when(flag == "5", 1).otherwise(2).cast("int").alias("priority"),
        F.when(line, F.when(over, ended).otherwise(going)).otherwise(root).alias("status"), "created_at",
    )


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activities(spark, sf_dir).filter("depth = 0")


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activities(spark, sf_dir).filter("depth = 1")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(rows(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"signup": "Enqueued", "view": "Dequeued", "click": "Yielded", "purchase": "Completed", "error": "Failed"}
    kind = F.col("event_type")
    for old, new in names.items():
        kind = F.when(F.col("event_type") == old, new).otherwise(kind)
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") * 1000).alias("activity_id"), F.lit("main").alias("queue_name"), kind.alias("event_type"), F.lit(None).cast("string").alias("worker_id"), F.col("props").alias("detail"), F.col("ts").alias("created_at"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results_of(activities(spark, sf_dir))


def results_of(activities: DataFrame) -> DataFrame:
    """Terminal activities' own results, and a checkpoint of each child owned by its root."""
    acts = activities.select("id", "status", "payload", "created_at")
    own = acts.filter(F.col("status").isin(S.TERMINAL)).select(F.col("id").alias("activity_id"), F.when(F.col("status") == "completed", "Ok").otherwise("Err").alias("state"), F.col("payload").alias("data"), (F.col("created_at") + _hours(48)).alias("created_at"), F.col("id").alias("owner_activity_id"), F.lit(None).cast("string").alias("step"))
    return own.unionByName(checkpoints_of(activities))


def checkpoints_of(activities: DataFrame) -> DataFrame:
    kids, rn = activities.filter("depth = 1"), F.col("id") % 1000
    step = F.concat(F.when(rn % 3 == 0, "run").when(rn % 3 == 1, "sleep").otherwise("signal"), F.lit(":s"), rn.cast("string"))
    return kids.select((-F.col("id")).alias("activity_id"), F.lit("Ok").alias("state"), F.col("payload").alias("data"), "created_at", F.col("root_activity_id").alias("owner_activity_id"), step.alias("step"))


def idempotency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keys_of(activities(spark, sf_dir))


def keys_of(activities: DataFrame) -> DataFrame:
    k = F.floor(F.col("id") / 1000)
    return activities.filter("idempotency_key IS NOT NULL").select("queue_name", "idempotency_key", F.when(k % 50 == 0, -F.col("id")).otherwise(F.col("id")).alias("activity_id"), "created_at")


def worker_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(s.alias("pool_id"), F.lit("main").alias("queue_name"), (1 + s % 16).cast("int").alias("max_workers"), (as_of() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (s % 120).cast("decimal(18,6)"))).alias("last_seen_at"))


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands_of(activities(spark, sf_dir))


def commands_of(activities: DataFrame) -> DataFrame:
    """An acknowledgement of every activity in process, some by a worker that no longer holds it."""
    h = F.col("id") % 1000 + F.floor(F.col("id") / 1000)
    outcome = F.when(h % 4 == 0, "success").when(h % 4 == 1, "non_retryable").otherwise("retryable")
    worker = F.when(h % 11 == 0, "stale").otherwise(F.col("current_worker_id"))
    return activities.filter("status = 'processing'").select("id", outcome.alias("outcome"), worker.alias("worker_id"), F.when(h % 3 == 0, 'bad "quote"').when(h % 3 == 1, "line\nand \\ slash").otherwise("boom2").alias("error"), F.concat(F.lit('{"done":'), F.col("id").cast("string"), F.lit("}")).alias("data"))
