"""Counters that the transitions' own jobs count as they run, and where they go.

A sink is a callable (counter, increment). Engines count by ``observed``; anything that reads the log as a stream counts by
``observed_stream`` and a ``Counters`` listener. Neither reads the rows a second time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.transitions import COUNTERS

NAME = "tidemark"
#: What the events of a committed batch say of the counters; a lost completion logs none.
BY_EVENT = {"Completed": "activity_completed", "Yielded": "activity_yielded", "Retrying": "activity_retry", "DeadLetter": "activity_retry", "Failed": "activity_failed_non_retry"}


def _counts(column: str, names) -> list:
    return [F.count_if(F.col(column) == n).alias(n) for n in names]


def observed(rows: DataFrame, counted: DataFrame) -> tuple[DataFrame, Observation]:
    """rows as they are; when they are written, the observation has the counters of ``counted`` (a column ``counter``), which ride along and are left out."""
    seen = Observation()
    both = rows.withColumn("counter", F.lit(None).cast("string")).unionByName(counted.filter("counter IS NOT NULL").select("counter"), allowMissingColumns=True)
    return both.observe(seen, *_counts("counter", COUNTERS)).filter("counter IS NULL").drop("counter"), seen


def observed_stream(events: DataFrame) -> DataFrame:
    """A stream of events (event_type) that counts by kind of event in each of its batches."""
    known = [F.count_if(F.col("event_type").isin([e for e, c in BY_EVENT.items() if c == name])).alias(name) for name in dict.fromkeys(BY_EVENT.values())]
    return events.observe(NAME, *known)


class Counters(StreamingQueryListener):
    """Adds up what observed streams count, and passes it on. Register by ``spark.streams.addListener``."""

    def __init__(self, sink: Callable[[str, int], None] | None = None):
        self.total, self.sink = Counter(), sink

    def add(self, counts: dict) -> None:
        for name, n in counts.items():
            if n:
                self.total[name] += n
                if self.sink:
                    self.sink(name, n)

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(NAME)
        if row is not None:
            self.add(row.asDict())

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
