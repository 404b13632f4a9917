"""State transitions as set operations: DataFrames of activities and commands in, rows of next state out.

Time is a parameter. Each transition names the event it logs; nothing is changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators.inspect import in_queue

#: How a taken idempotency key is met.
BEHAVIOURS = ["return_existing", "allow_reuse", "allow_reuse_on_failure", "no_reuse"]
MOST_DEPTH = 32
#: The counters of an engine.
COUNTERS = ["activity_completed", "activity_lost_completion", "activity_yielded", "activity_retry", "activity_failed_non_retry", "activity_timeout", "activity_trees_swept"]
#: The error of a handler that ran past its time.
TIMEOUT = "timeout"


def new_activities(requests: DataFrame, as_of) -> DataFrame:
    """Defaults of a new activity: normal priority, 3 attempts, 300 s, base delay 1 s, cap an hour, its own root.

    requests: id, queue_name, activity_type, payload and, where given, priority, max_retries,
    timeout_seconds, retry_delay_seconds, max_retry_delay_seconds, delay_seconds, parent_activity_id,
    root_activity_id, parent_depth.
    """
    given = set(requests.columns)
    get = lambda name, default, kind: F.coalesce(F.col(name), F.lit(default).cast(kind)).cast(kind).alias(name) if name in given else F.lit(default).cast(kind).alias(name)
    delay = F.col("delay_seconds") if "delay_seconds" in given else F.lit(None).cast("long")
    scheduled = F.when(delay.isNotNull(), S.plus_seconds(as_of, delay))
    none = F.lit(None).cast(requests.schema["id"].dataType)
    parent = F.col("parent_activity_id") if "parent_activity_id" in given else none
    root = F.col("root_activity_id") if "root_activity_id" in given else none
    depth = F.least(F.coalesce(F.col("parent_depth") + 1, F.lit(0)), F.lit(32767)) if "parent_depth" in given else F.lit(0)
    return requests.select(
        "id", "queue_name", "activity_type", "payload", get("priority", 2, "int"), get("max_retries", 3, "int"), get("timeout_seconds", 300, "long"), get("retry_delay_seconds", 1, "long"), get("max_retry_delay_seconds", 3600, "long"),
        as_of.alias("created_at"), scheduled.alias("scheduled_at"), F.when(scheduled.isNotNull(), "scheduled").otherwise("pending").alias("status"), F.lit(0).alias("retry_count"),
        parent.alias("parent_activity_id"), F.coalesce(root, F.col("id")).alias("root_activity_id"), depth.cast("int").alias("depth"),
    )


def enqueue(new: DataFrame) -> DataFrame:
    """The event of each new activity: one with a schedule is Scheduled, even in the past."""
    detail = F.to_json(F.struct("activity_type", "priority", "scheduled_at"))
    return new.select("id", "status", F.when(F.col("scheduled_at").isNotNull(), "Scheduled").otherwise("Enqueued").alias("event_type"), detail.alias("detail"))


def _dealt(df: DataFrame, parts: int | None, *by: str) -> DataFrame:
    """Rows dealt by some columns into so many partitions; without a number, as the session deals them."""
    return df.repartition(parts, *by) if parts else df


def resolve_keys(claims: DataFrame, keys: DataFrame, activities: DataFrame, behaviour: str | None = None, parts: int | None = None) -> DataFrame:
    """What becomes of claims (queue_name, idempotency_key, id, created_at) of idempotency keys, by one behaviour or by each claim's own in a column ``behaviour``.

    Claims of a key meet what is stored, in order of time and id, until one of them takes the key; the later ones meet that one, which is
    new and so has not failed, or whoever takes the key after it. A key whose activity is gone is reclaimed under any behaviour.
    Actions: enqueue, reclaim, return, reuse, conflict, duplicate. Returns queue_name, idempotency_key, id, action, activity_id.

    Only claimed keys look up their activity, so claims of free keys, which have none, never meet in one task. parts: partitions of each join.
    """
    if behaviour is not None and behaviour not in BEHAVIOURS:
        raise ValueError(behaviour)
    key, b = ["queue_name", "idempotency_key"], F.lit(behaviour) if behaviour else F.col("behaviour")
    order = Window.partitionBy(*key).orderBy("created_at", "id")
    claimed = _dealt(claims.select(*key), parts, *key)
    held = _dealt(keys.select(*key, F.col("activity_id").alias("held_id")), parts, *key).join(claimed, key, "left_semi")
    state = activities.select(F.col("id").alias("held_id"), F.col("status").alias("held_status"))
    held = _dealt(_dealt(held, parts, "held_id").join(_dealt(state, parts, "held_id"), "held_id", "left"), parts, *key)
    c = _dealt(claims.select(*key, "id", "created_at", b.alias("behaviour")), parts, *key).join(held, key, "left")
    # what each would become by itself, and behind another claim that has taken the key
    reuse = F.when(F.col("behaviour") == "allow_reuse", "reuse").when(F.col("behaviour") == "return_existing", "return").when(F.col("behaviour") == "no_reuse", "duplicate")
    alone = F.when(F.col("held_id").isNull(), "enqueue").when(F.col("held_status").isNull(), "reclaim").otherwise(reuse.when(F.col("held_status").isin("failed", "dead_letter"), "reuse").otherwise("conflict"))
    behind = reuse.otherwise("conflict")
    c = c.withColumns({"alone": alone, "behind": behind}).withColumn("takes", F.col("alone").isin("enqueue", "reclaim", "reuse"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("taken", F.coalesce(F.max("takes").over(before), F.lit(False)))
    action = F.when(F.col("taken"), F.col("behind")).otherwise(F.col("alone"))
    own = F.when(action.isin("enqueue", "reclaim", "reuse"), F.col("id"))
    holder = F.coalesce(F.last(own, ignorenulls=True).over(before), F.col("held_id"))
    return c.select(*key, "id", action.alias("action"), F.when(action == "return", holder).otherwise(own).alias("activity_id"))


def orphan_keys(keys: DataFrame, activities: DataFrame) -> DataFrame:
    return keys.join(activities.select(F.col("id").alias("activity_id")), "activity_id", "left_anti").select("queue_name", "idempotency_key", "activity_id")


def eligible(activities: DataFrame, as_of) -> DataFrame:
    """Pending rows, whatever their schedule, and due ones."""
    return activities.filter((F.col("status") == "pending") | (F.col("status").isin(S.DUE) & (F.col("scheduled_at") <= as_of)))


def claim(activities: DataFrame, queue: str, slots: int, worker: str, as_of, lease_ms: int, types: list[str] | None = None) -> DataFrame:
    """The next activities of a queue for so many free slots: one global top-k."""
    found = in_queue(eligible(activities, as_of), queue)
    if types:
        found = found.filter(F.col("activity_type").isin(types))
    found = found.orderBy(F.desc("priority"), F.desc("retry_count"), F.coalesce("scheduled_at", "created_at").asc_nulls_last(), "id").limit(slots)
    return _claimed(found, worker, as_of, lease_ms)


def claim_all_queues(activities: DataFrame, slots: DataFrame, as_of, lease_ms: int) -> DataFrame:
    """Extension: slots (queue_name, worker_id, slots) of many queues in one pass.

    The largest number of slots, a literal, cuts each queue's rows in every partition before the shuffle; a queue's own slots cut the rest.
    """
    most = slots.agg(F.max("slots")).first()[0] or 0
    order = Window.partitionBy("queue_name").orderBy(F.desc("priority"), F.desc("retry_count"), F.coalesce("scheduled_at", "created_at").asc_nulls_last(), "id")
    found = eligible(activities, as_of).withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= most).join(slots, "queue_name").filter(F.col("turn") <= F.col("slots"))
    return _claimed(found, F.col("worker_id"), as_of, lease_ms)


def _claimed(found: DataFrame, worker, as_of, lease_ms: int) -> DataFrame:
    worker = F.lit(worker) if isinstance(worker, str) else worker
    attempt = [(F.coalesce("attempt", F.lit(0)) + 1).alias("attempt")] if "attempt" in found.columns else []
    return found.select(
        "id", "queue_name", "activity_type", "priority", "retry_count", F.lit("processing").alias("status"), worker.alias("current_worker_id"), as_of.alias("started_at"),
        S.lease_deadline_ms(S.epoch_ms(as_of), "timeout_seconds", lease_ms).alias("lease_deadline_ms"), F.lit("Dequeued").alias("event_type"), *attempt,
    )


def fenced(activities: DataFrame, commands: DataFrame, parts: int | None = None) -> DataFrame:
    """Commands of workers that still hold their activity in process.

    Where both have ``attempt``, the token that each claim of an activity raises, it must be the claim's own: a worker that has claimed the same
    activity again can't end it for its earlier attempt. Of several commands for one attempt the first counts, by ``seq`` where they have it.
    parts: partitions of the join.
    """
    c = commands.withColumnRenamed("worker_id", "current_worker_id")
    fence = ["id", "current_worker_id"]
    if "attempt" in commands.columns and "attempt" in activities.columns:
        fence.append("attempt")
        order = F.col("seq").asc_nulls_last() if "seq" in commands.columns else F.xxhash64(*[x for x in c.columns if x != "id"])
        c = _dealt(c, parts, *fence).withColumn("_turn", F.row_number().over(Window.partitionBy(*fence).orderBy(order))).filter("_turn = 1").drop("_turn")
    elif "attempt" in commands.columns:
        c = c.drop("attempt")
    return _dealt(activities.filter("status = 'processing'"), parts, *fence).join(_dealt(c, parts, *fence), fence)


def stale_acks(activities: DataFrame, commands: DataFrame) -> DataFrame:
    """Commands (id, worker_id, attempt, seq) that the fence keeps out, each once, and why.

    ``unknown``: no such activity; ``ended``: it is not in process; ``foreign``: another worker holds it; ``late``: the worker's claim is an earlier one (or it
    names none); ``early``: there is no such claim yet; ``repeated``: an earlier command, by seq, has ended this attempt.
    """
    state = activities.select("id", "status", "current_worker_id", F.col("attempt").alias("held_attempt"))
    c = commands.select("id", "worker_id", "attempt", "seq").join(state, "id", "left")
    turn = F.row_number().over(Window.partitionBy("id", "worker_id", "attempt").orderBy(F.col("seq").asc_nulls_last()))
    reason = (
        F.when(F.col("status").isNull(), "unknown").when(F.col("status") != "processing", "ended").when(~F.col("worker_id").eqNullSafe(F.col("current_worker_id")), "foreign")
        .when(F.col("attempt").isNull() | (F.col("attempt") < F.col("held_attempt")), "late").when(~F.col("attempt").eqNullSafe(F.col("held_attempt")), "early").when(turn > 1, "repeated")
    )
    return c.withColumn("reason", reason).filter("reason IS NOT NULL").select("id", "worker_id", "attempt", "seq", "reason")


def counted(activities: DataFrame, commands: DataFrame, parts: int | None = None) -> DataFrame:
    """Commands (id, worker_id, outcome, error) with the ``counter`` each raises: what a handler asked for, and for an end or a wait also whether its worker still held the activity."""
    fence = ["id", "worker_id", *(["attempt"] if "attempt" in commands.columns and "attempt" in activities.columns else [])]
    live = fenced(activities, _dealt(commands.select(*fence), parts, *fence).distinct(), parts).withColumnRenamed("current_worker_id", "worker_id").select(*fence, F.lit(True).alias("live"))
    held, outcome = F.col("live").isNotNull(), F.col("outcome")
    counter = (
        F.when(outcome == "success", F.when(held, "activity_completed").otherwise("activity_lost_completion")).when(outcome == "yield", F.when(held, "activity_yielded"))
        .when((outcome == "retryable") & F.col("error").eqNullSafe(TIMEOUT), "activity_timeout").when(outcome == "retryable", "activity_retry").when(outcome == "non_retryable", "activity_failed_non_retry")
    )
    return _dealt(commands, parts, *fence).join(live, fence, "left").select(*commands.columns, counter.alias("counter"))


def counters(counted: DataFrame, swept: DataFrame) -> DataFrame:
    """All counters by name, those at 0 too: of counted commands, and of the trees that a sweep takes (one row each)."""
    names = F.explode(F.array(*[F.lit(c) for c in COUNTERS]))
    none = counted.sparkSession.range(1).select(names.alias("counter"), F.lit(0).alias("n"))
    ones = counted.filter("counter IS NOT NULL").select("counter", F.lit(1).alias("n"))
    trees = swept.select(F.lit("activity_trees_swept").alias("counter"), F.lit(1).alias("n"))
    return none.unionByName(ones).unionByName(trees).groupBy("counter").agg(F.sum("n").alias("value"))


def ack_success(activities: DataFrame, commands: DataFrame, as_of, parts: int | None = None) -> DataFrame:
    """Completed, with a result whether or not there is data. Stale commands give no row."""
    return fenced(activities, commands, parts).filter("outcome = 'success'").select("id", F.lit("completed").alias("status"), as_of.alias("completed_at"), F.col("current_worker_id").alias("last_worker_id"), F.lit("Ok").alias("state"), F.coalesce("data", F.lit("null")).alias("data"), F.lit("Completed").alias("event_type"), "parent_activity_id")


def failure(error, kind, as_of):
    """The result of an activity that failed for good, as JSON."""
    return F.to_json(F.struct(error.alias("error"), kind.alias("type"), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("failed_at")))


def ack_failure(activities: DataFrame, commands: DataFrame, as_of, parts: int | None = None) -> DataFrame:
    """Failed, retrying or dead-lettered. Only a retry counts; only the end writes a result and wakes the parent."""
    retryable = F.col("outcome") == "retryable"
    retry = retryable & S.can_retry("retry_count", "max_retries")
    status = F.when(~retryable, "failed").when(retry, "retrying").otherwise("dead_letter")
    delay = S.retry_delay_seconds("retry_delay_seconds", "retry_count", "max_retry_delay_seconds")
    found = fenced(activities, commands, parts).filter("outcome <> 'success'")
    data = failure(F.col("error"), F.when(retryable, "dead_letter").otherwise("non_retryable"), as_of)
    return found.select(
        "id", status.alias("status"), F.when(retry, F.col("retry_count") + 1).otherwise(F.col("retry_count")).alias("retry_count"),
        F.when(retry, S.plus_seconds(as_of, delay)).alias("scheduled_at"), F.when(~retry, as_of).alias("completed_at"), F.when(~retry, F.col("started_at")).alias("started_at"),
        F.col("error").alias("last_error"), as_of.alias("last_error_at"), F.col("current_worker_id").alias("last_worker_id"),
        F.when(~retry, "Err").alias("state"), F.when(~retry, data).alias("data"), F.when(~retryable, "Failed").when(retry, "Retrying").otherwise("DeadLetter").alias("event_type"), F.when(~retry, F.col("parent_activity_id")).alias("wakes"),
    )


def reap(activities: DataFrame, as_of, batch: int | None = 100) -> DataFrame:
    """Leases that ran out: back to pending without delay, or dead; both count an attempt. id orders the batch."""
    expired = activities.filter((F.col("status") == "processing") & (F.col("lease_deadline_ms") < S.epoch_ms(as_of)))
    if batch is not None:
        expired = expired.orderBy("id").limit(batch)
    again = S.can_retry("retry_count", "max_retries")
    return expired.select("id", F.when(again, "pending").otherwise("dead_letter").alias("status"), (F.col("retry_count") + 1).alias("retry_count"), F.when(~again, as_of).alias("completed_at"), F.col("current_worker_id").alias("last_worker_id"), F.when(again, "Requeued").otherwise("DeadLetter").alias("event_type"), F.when(~again, "Err").alias("state"), F.when(~again, F.col("parent_activity_id")).alias("wakes"))


def park(activities: DataFrame, yields: DataFrame, parts: int | None = None) -> DataFrame:
    """Yielded activities wait until wake_at; attempts stay, the worker and its lease go. yields: id, worker_id, wake_at, kind, step."""
    detail = F.to_json(F.struct("kind", "step"))
    return fenced(activities, yields, parts).select("id", F.lit("waiting").alias("status"), F.col("wake_at").alias("scheduled_at"), "retry_count", F.lit(None).cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("long").alias("lease_deadline_ms"), F.col("current_worker_id").alias("last_worker_id"), F.lit("Yielded").alias("event_type"), detail.alias("detail"))


def wake(activities: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of ids (id) that wait become pending without a schedule; others are left alone."""
    return activities.filter("status = 'waiting'").join(ids.select("id").distinct(), "id", "left_semi").select("id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("scheduled_at"))


def wake_parents(activities: DataFrame, ended: DataFrame) -> DataFrame:
    """Any child's end wakes its parent. ended: parent_activity_id."""
    return wake(activities, ended.filter("parent_activity_id IS NOT NULL").select(F.col("parent_activity_id").alias("id")))


def signal(activities: DataFrame, signals: DataFrame) -> DataFrame:
    """signals (signal_id, id, name, payload): a result under the signal's id, owned by the activity, and a wake. Unknown activities give delivered = false."""
    found = signals.join(activities.select("id", "status"), "id", "left")
    known = F.col("status").isNotNull()
    return found.select("signal_id", "id", known.alias("delivered"), F.coalesce(F.col("status") == "waiting", F.lit(False)).alias("woke"), F.when(known, F.concat(F.lit("signal:"), F.col("name"))).alias("step"), F.when(known, F.col("payload")).alias("data"), F.when(known, "Signaled").alias("event_type"))


def signal_by_key(activities: DataFrame, keys: DataFrame, signals: DataFrame) -> DataFrame:
    """signals (queue_name, activity_type, key, name, signal_id, payload) find their activity by '<key>-<type>'; empty parts are refused."""
    good = signals.filter("activity_type <> '' AND key <> '' AND name <> ''").withColumn("idempotency_key", S.signal_key("key", "activity_type"))
    return signal(activities, good.join(keys.select("queue_name", "idempotency_key", F.col("activity_id").alias("id")), ["queue_name", "idempotency_key"], "left").select("signal_id", "id", "name", "payload"))


def latest_results(stored: DataFrame) -> DataFrame:
    """Last write wins. stored: activity_id, seq, state, data, owner_activity_id, step."""
    return stored.groupBy("activity_id").agg(F.max_by(F.struct("state", "data", "owner_activity_id", "step"), "seq").alias("r")).select("activity_id", "r.*")


def extend_lease(activities: DataFrame, extensions: DataFrame, as_of) -> DataFrame:
    """extensions (id, by_seconds): now and so much, for activities in process, whoever holds them."""
    found = activities.filter("status = 'processing'").join(extensions, "id")
    return found.select("id", (S.epoch_ms(as_of) + F.col("by_seconds") * 1000).alias("lease_deadline_ms"), F.lit("LeaseExtended").alias("event_type"))


def spawn_links(resolved: DataFrame, activities: DataFrame) -> DataFrame:
    """resolved (child_id, parent_id): reuse of a child that another parent made is logged."""
    found = resolved.join(activities.select(F.col("id").alias("child_id"), "parent_activity_id"), "child_id")
    return found.filter(~F.col("parent_activity_id").eqNullSafe(F.col("parent_id"))).select("child_id", "parent_id", F.lit("SpawnLinked").alias("event_type"))


def spawn(parents: DataFrame, as_root: bool = False) -> DataFrame:
    """Lineage of a child of each parent (id, root_activity_id, depth)."""
    if as_root:
        none = F.lit(None).cast(parents.schema["id"].dataType)
        return parents.select(F.col("id").alias("caller"), none.alias("parent_activity_id"), none.alias("root_activity_id"), F.lit(0).alias("depth"))
    return parents.select(F.col("id").alias("caller"), F.col("id").alias("parent_activity_id"), F.coalesce("root_activity_id", "id").alias("root_activity_id"), F.least(F.col("depth") + 1, F.lit(32767)).cast("int").alias("depth"))


def depth_violations(spawned: DataFrame, most: int = MOST_DEPTH) -> DataFrame:
    return spawned.filter(F.col("depth") > most)


# --- retention --------------------------------------------------------------------------------


def expired_roots(activities: DataFrame, queue: str, as_of, completed_ttl: int = 0, failed_ttl: int = 0, batch: int | None = None, parts: int | None = None) -> DataFrame:
    """Roots whose whole tree may go: ended longer ago than their kind's seconds (0: for ever), with no open activity below.

    One shuffle: each row that keeps its tree, or is a root whose time is over, counts for that tree, pre-aggregated unless parts says into how many partitions; old rows without a root are their own.
    """
    mine = in_queue(activities, queue)
    age = lambda ttl: S.plus_seconds(F.col("completed_at"), F.lit(int(ttl))) < as_of
    old = F.lit(False)
    if completed_ttl > 0:
        old = old | ((F.col("status") == "completed") & age(completed_ttl))
    if failed_ttl > 0:
        old = old | (F.col("status").isin("failed", "dead_letter") & age(failed_ttl))
    going = ~F.col("status").isin(S.TERMINAL)
    tree = F.when(going, F.coalesce("root_activity_id", "id")).when(F.col("parent_activity_id").isNull() & old, F.col("id"))
    trees = mine.select(tree.alias("id"), going.alias("going"), F.when(~going, F.col("completed_at")).alias("completed_at")).filter("id IS NOT NULL")
    found = _dealt(trees, parts, "id").groupBy("id").agg(F.max("going").alias("going"), F.max("completed_at").alias("completed_at")).filter("NOT going").select("id", "completed_at")
    return found if batch is None else found.orderBy("completed_at", "id").limit(batch)


def sweep(tables: dict[str, DataFrame], roots: DataFrame, parts: int | None = None) -> dict[str, DataFrame]:
    """Rows of activities, results, events and keys that go with the trees of roots (id).

    The trees' ids come from one semi join by root; results, by owner or own id, keys and events then meet those ids, each shuffled once. parts: partitions of each join.
    """

    def those(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
        return _dealt(df, parts, key).join(_dealt(of.toDF(key), parts, key), key, "left_semi")

    ids = those(tables["activities"].select("id", F.coalesce("root_activity_id", "id").alias("root")), roots.select("id"), "root").select("id")
    # a result that owns itself is one row
    own = F.when(F.col("owner_activity_id").eqNullSafe(F.col("activity_id")), F.array("activity_id")).otherwise(F.array("owner_activity_id", "activity_id"))
    by = those(tables["results"].select("activity_id", F.explode(own).alias("id")).filter("id IS NOT NULL"), ids, "id")
    results = _dealt(by.select("activity_id"), parts, "activity_id").distinct()
    return {
        "activities": ids,
        "results": results,
        "events": those(tables["events"].select("activity_id", "id"), ids.union(results), "activity_id").select("id"),
        "keys": those(tables["keys"].select("activity_id", "queue_name", "idempotency_key"), ids, "activity_id").select("queue_name", "idempotency_key"),
    }
