"""Inspection: what a queue holds. Each function maps tables to a DataFrame, lazily.

A filter that isn't asked for adds no predicate to the plan. Listings end in a sort with a
limit, which Spark runs as one top-k. Null order is explicit, and id breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as S

#: Fixed values of the interface.
PAGE, MOST_PAGE = 50, 1000
POOL_SECONDS = 60


def in_queue(activities: DataFrame, queue: str | None) -> DataFrame:
    return activities if queue is None else activities.filter(F.col("queue_name") == queue)


def page(df: DataFrame, *order, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    """A page of a listing. Offsets below 0 and limits out of 1..MOST_PAGE fall back to the defaults."""
    df = df.orderBy(*order)
    offset = offset if offset and offset > 0 else 0
    if limit is None:
        return df
    limit = min(limit, MOST_PAGE) if limit > 0 else PAGE
    return (df.offset(offset) if offset else df).limit(limit)


def snapshot(activities: DataFrame) -> DataFrame:
    """The public form of activities: labelled status, clamped priority, the time of the last change."""
    return activities.select(
        "id", "queue_name", "activity_type", "payload", S.clamp_priority("priority").alias("priority"), S.status_label("status").alias("status"),
        "created_at", "scheduled_at", "started_at", "completed_at", F.coalesce("started_at", "completed_at", "created_at").alias("status_updated_at"),
        "lease_deadline_ms", "current_worker_id", "last_worker_id", "retry_count", "max_retries", "timeout_seconds", "retry_delay_seconds", "last_error", "last_error_at",
        "metadata", "idempotency_key", "parent_activity_id", "root_activity_id", "depth",
    )


def metadata_map(metadata):
    """Metadata as a map, for callers that want it typed."""
    return F.from_json(metadata, "map<string,string>")


# --- statistics: one scan, conditional aggregates -------------------------------------------


def _counts(status, names: list[str], prefix: str = ""):
    return [F.count_if(status == n).alias(prefix + n) for n in names]


OPEN_STATES = ["pending", "processing", "scheduled", "retrying", "waiting", "dead_letter", "failed"]
ALL_STATES = ["pending", "processing", "scheduled", "retrying", "waiting", "completed", "failed", "dead_letter"]


def stats_status(activities: DataFrame, queue: str | None) -> DataFrame:
    """Seven counts; completed activities are only counted as roots."""
    return in_queue(activities, queue).agg(*_counts(F.col("status"), OPEN_STATES))


def stats_active_workers(activities: DataFrame, queue: str | None) -> DataFrame:
    return in_queue(activities, queue).agg(F.countDistinct(F.when(F.col("status") == "processing", F.col("current_worker_id"))).alias("active_workers"))


def stats_roots(roots: DataFrame, queue: str | None) -> DataFrame:
    return in_queue(roots, queue).filter("parent_activity_id IS NULL").agg(*_counts(F.col("status"), ALL_STATES, "root_"))


def stats_priority(activities: DataFrame, queue: str | None) -> DataFrame:
    """Pending activities by priority; other values are dropped, missing ones are 0."""
    pending = in_queue(activities, queue).filter("status = 'pending'")
    return pending.agg(*[F.count_if(F.col("priority") == p).alias(name.lower()) for p, name in S.PRIORITIES.items()])


def stats_capacity(pools: DataFrame, queue: str | None, as_of) -> DataFrame:
    """Workers of pools seen within the last minute; none is null."""
    seen = in_queue(pools, queue).filter(F.col("last_seen_at") > as_of - F.expr(f"INTERVAL '{POOL_SECONDS}' SECOND"))
    return seen.agg(F.nullif(F.coalesce(F.sum("max_workers"), F.lit(0)), F.lit(0)).alias("max_workers"))


def stats(activities: DataFrame, pools: DataFrame, queue: str | None, as_of) -> DataFrame:
    """All of the above in one row: one scan of activities and one of pools."""
    status, root = F.col("status"), F.col("parent_activity_id").isNull()
    acts = in_queue(activities, queue).agg(
        *_counts(status, OPEN_STATES), F.countDistinct(F.when(status == "processing", F.col("current_worker_id"))).alias("active_workers"),
        *[F.count_if(root & (status == n)).alias(f"root_{n}") for n in ALL_STATES],
        *[F.count_if((status == "pending") & (F.col("priority") == p)).alias(f"priority_{name.lower()}") for p, name in S.PRIORITIES.items()],
    )
    one = F.lit(1).alias("_one")
    return acts.select(one, "*").join(stats_capacity(pools, queue, as_of).select(one, "*"), "_one").drop("_one")  # a row each


# --- listings -------------------------------------------------------------------------------


def by_status(activities: DataFrame, queue: str | None, status: str, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    """Pending or processing: priority, then retries, then age."""
    found = in_queue(activities, queue).filter(F.col("status") == status)
    return snapshot(page(found, F.desc("priority"), F.desc("retry_count"), F.asc_nulls_last("created_at"), "id", offset=offset, limit=limit))


def scheduled(activities: DataFrame, queue: str | None, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    found = in_queue(activities, queue).filter(F.col("status").isin(S.DUE))
    return snapshot(page(found, F.asc_nulls_last("scheduled_at"), F.asc_nulls_last("created_at"), "id", offset=offset, limit=limit))


def completed(activities: DataFrame, queue: str | None, cron: bool, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    """Completed and failed ones, from cron or not."""
    from_cron = S.is_cron("metadata")
    found = in_queue(activities, queue).filter(F.col("status").isin("completed", "failed") & (from_cron if cron else ~from_cron))
    return snapshot(page(found, F.desc_nulls_first("completed_at"), F.desc("created_at"), "id", offset=offset, limit=limit))


def dead_letters(activities: DataFrame, queue: str | None, as_of, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    found = in_queue(activities, queue).filter("status = 'dead_letter'")
    found = snapshot(page(found, F.desc_nulls_first("completed_at"), "id", offset=offset, limit=limit))
    return found.withColumns({"error": F.coalesce("last_error", F.lit("")), "failed_at": F.coalesce("completed_at", as_of)})


#: What a listing of a status is ordered by, newest first.
RECENT_BY = {"completed": "completed_at", "failed": "last_error_at", "retrying": "last_error_at", "dead_letter": "last_error_at", "processing": "started_at", "scheduled": "scheduled_at"}


def _recent_time(status: str | None):
    return F.coalesce(RECENT_BY[status], "created_at") if status in RECENT_BY else F.col("created_at")


def recent(activities: DataFrame, queue: str | None, status: str | None = None, roots_only: bool = True, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    """Newest activities; completed and failed ones without those of cron."""
    found = in_queue(activities, queue)
    if roots_only:
        found = found.filter("parent_activity_id IS NULL")
    if status is not None:
        found = found.filter(F.col("status") == status)
    if status in ("completed", "failed"):
        found = found.filter(~S.is_cron("metadata"))
    return snapshot(page(found, _recent_time(status).desc_nulls_first(), "id", offset=offset, limit=limit))


def cron(activities: DataFrame, queue: str | None, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    return snapshot(page(in_queue(activities, queue).filter(S.is_cron("metadata")), F.desc("created_at"), "id", offset=offset, limit=limit))


# --- one activity ---------------------------------------------------------------------------


def activity(activities: DataFrame, queue: str | None, activity_id) -> DataFrame:
    return snapshot(in_queue(activities, queue).filter(F.col("id") == activity_id))


def result(results: DataFrame, activity_id) -> DataFrame:
    """Whatever the queue."""
    return results.filter(F.col("activity_id") == activity_id).select("activity_id", "state", "data")


def activity_events(events: DataFrame, activity_id, limit: int | None = PAGE) -> DataFrame:
    """Whatever the queue, oldest first."""
    found = page(events.filter(F.col("activity_id") == activity_id), "created_at", "id", limit=limit)
    return found.select("id", "activity_id", S.bare_event_type("event_type").alias("event_type"), "worker_id", "detail", "created_at")


def activity_steps(results: DataFrame, activity_id) -> DataFrame:
    found = results.filter((F.col("owner_activity_id") == activity_id) & F.col("step").isNotNull())
    return found.orderBy("created_at", "activity_id").select("activity_id", S.step_kind("step").alias("kind"), S.step_name("step").alias("name"), "state", "data", "created_at")


def children(activities: DataFrame, queue: str | None, activity_id, offset: int = 0, limit: int | None = PAGE) -> DataFrame:
    return snapshot(page(in_queue(activities, queue).filter(F.col("parent_activity_id") == activity_id), "created_at", "id", offset=offset, limit=limit))


def subtree(activities: DataFrame, queue: str | None, activity_id) -> DataFrame:
    """The whole tree of any of its activities; roots of old rows name no root."""
    mine = in_queue(activities, queue)
    root = mine.filter(F.col("id") == activity_id).select(F.coalesce("root_activity_id", "id").alias("_root"))
    found = mine.join(F.broadcast(root), F.coalesce("root_activity_id", "id") == F.col("_root"), "left_semi")  # one row
    return snapshot(found.orderBy("depth", "created_at", "id"))


def key_lookup(keys: DataFrame, queue: str, key: str) -> DataFrame:
    return keys.filter((F.col("queue_name") == queue) & (F.col("idempotency_key") == key)).select("queue_name", "idempotency_key", "activity_id")


def step_edges(activities: DataFrame, queue: str | None) -> DataFrame:
    """Parent, child and the step name by which the parent started it."""
    found = in_queue(activities, queue).withColumn("label", S.step_label("idempotency_key")).filter("label IS NOT NULL")
    return found.select("parent_activity_id", "id", "label")


# --- bulk forms, which go beyond the point queries --------------------------------------------


def tree_sizes(activities: DataFrame, queue: str | None) -> DataFrame:
    """Extension: every tree's size and open activities, in one aggregate."""
    root = F.coalesce("root_activity_id", "id")
    return in_queue(activities, queue).groupBy(root.alias("root_id")).agg(F.count("*").alias("n"), F.count_if(~F.col("status").isin(S.TERMINAL)).alias("n_open"), F.max("depth").alias("depth"))
