"""Worker pools as a log of beats; the latest beat of a pool is its state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def registered(pools: DataFrame, as_of) -> DataFrame:
    """Beats of new pools (pool_id, queue_name, max_workers, activity_types)."""
    return pools.select("pool_id", "queue_name", "max_workers", "activity_types", as_of.alias("last_seen_at"), F.lit(False).alias("gone"))


def heartbeat(current: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    """Beats of known pools (pool_id); unknown ones give none."""
    return current.join(ids.select("pool_id"), "pool_id", "left_semi").withColumns({"last_seen_at": as_of, "gone": F.lit(False)})


def deregistered(current: DataFrame, ids: DataFrame, as_of) -> DataFrame:
    return heartbeat(current, ids, as_of).withColumn("gone", F.lit(True))


def current(beats: DataFrame) -> DataFrame:
    """The latest beat of each pool; a pool that left is gone. Of beats at one time, leaving wins."""
    rest = [c for c in beats.columns if c != "pool_id"]
    last = beats.groupBy("pool_id").agg(F.max_by(F.struct(*rest), F.struct("last_seen_at", "gone")).alias("r"))
    return last.select("pool_id", "r.*").filter(~F.col("gone")).drop("gone")
