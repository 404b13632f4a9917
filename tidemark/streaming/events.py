"""Events: a tail by cursor, streams in order of commits or of plain files, a fan-out hub and server-sent events."""

from __future__ import annotations

import json
import queue
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import commits

#: Fixed values of the interface.
TAIL_ROWS, BUFFER, MOST_SUBSCRIBERS, HEARTBEAT_SECONDS = 500, 100, 64, 15
SCHEMA = "id long, activity_id string, queue_name string, event_type string, worker_id string, detail string, created_at timestamp_ntz"


def tail(events: DataFrame, cursor: int, limit: int = TAIL_ROWS) -> DataFrame:
    """The next events after a cursor, in order of id: one top-k."""
    return events.filter(F.col("id") > cursor).orderBy("id").limit(limit)


def stream(spark: SparkSession, path: str, cursor: int | None = None, per_trigger: int = 100, schema: str = SCHEMA) -> DataFrame:
    """New files of a folder of events, each row once; a cursor leaves out what came before. A log's own events come by committed()."""
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("recursiveFileLookup", True).parquet(path)
    return found if cursor is None else found.filter(F.col("id") > cursor)


def committed(spark: SparkSession, path: str, after: int | str = "latest") -> DataFrame:
    """The events of a log as its batches are committed, after one of them: a batch that was cut off is never seen."""
    return commits.follow(spark, path, "events", after)


def rates(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Extension: events per window and type, with a watermark for late ones."""
    timed = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


class Hub:
    """One stream for many subscribers. Each has a buffer; what doesn't fit is dropped for that one alone.

    The stream starts with the first subscriber and stops after the last. Events pass the driver
    in micro-batches, as for an inspection console; bulk readers take stream() itself.
    """

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, buffer: int = BUFFER, most: int = MOST_SUBSCRIBERS):
        """path: the events of a log."""
        self.spark, self.path, self.checkpoint, self.buffer, self.most = spark, path, checkpoint, buffer, most
        self.subscribers: dict[int, queue.Queue] = {}
        self.lock, self.query, self.next = threading.Lock(), None, 0

    def publish(self, rows: list[dict]) -> None:
        with self.lock:
            for row in rows:
                for q in self.subscribers.values():
                    try:
                        q.put_nowait(row)
                    except queue.Full:
                        pass  # a slow reader misses it

    def _start(self) -> None:
        def batch(df: DataFrame, _: int) -> None:
            for row in df.drop("seq", "number").orderBy("id").toLocalIterator():
                self.publish([row.asDict()])

        path = self.path.removesuffix("/events")
        # from now on, not from when the query's first batch begins
        self.query = committed(self.spark, path, commits.newest(path)).writeStream.foreachBatch(batch).option("checkpointLocation", f"{self.checkpoint}/{self.next}").trigger(processingTime="1 second").start()

    def subscribe(self) -> tuple[int, queue.Queue]:
        with self.lock:
            if len(self.subscribers) >= self.most:
                raise RuntimeError("too many subscribers")
            self.next += 1
            token, q = self.next, queue.Queue(self.buffer)
            first = not self.subscribers
            self.subscribers[token] = q
        if first:
            self._start()
        return token, q

    def leave(self, token: int) -> None:
        with self.lock:
            self.subscribers.pop(token, None)
            last = not self.subscribers
            found, self.query = (self.query, None) if last else (None, self.query)
        if found is not None:
            found.stop()


def frame(row: dict | None) -> str:
    """A server-sent event, or a heartbeat."""
    return ": ping\n\n" if row is None else f"data: {json.dumps(row, default=str, separators=(',', ':'))}\n\n"
