"""Durable timers as keyed state: processing-time timers that commands set, move and take away.

State and timers lie in the query's checkpoint: what falls due while nothing runs fires once when the query starts again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators import timers as T
from tidemark.sources import commits
from tidemark.streaming import keyed_state

FIRED = "activity_id string, timer string, kind string, due_ms long, attempt int, fired_ms long, seq long"


class Timers(StatefulProcessor):
    """An activity's armed timers by name. Commands of a batch are taken in order of seq, and none that is older than what armed a timer.

    Only armed timers are state: a timer that fired or was cancelled leaves nothing behind, so commands come in order of seq from batch to
    batch, as from the log's commits.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.armed = handle.getMapState("armed", "timer string", "kind string, due_ms long, attempt int, seq long")

    def _names(self) -> list[str]:
        return [name for (name,) in self.armed.keys()] if self.armed.exists() else []

    def _disarm(self, timer: str) -> None:
        due = self.armed.getValue((timer,))[1]
        self.armed.removeKey((timer,))
        # timers of one millisecond share a registration
        if all(self.armed.getValue((name,))[1] != due for name in self._names()):
            self.handle.deleteTimer(due)

    def handleInputRows(self, key, rows, timerValues):
        for row in sorted(rows, key=lambda r: r["seq"]):
            timer, armed = row["timer"], self.armed.containsKey((row["timer"],))
            if armed and self.armed.getValue((timer,))[3] > row["seq"]:
                continue
            if row["op"] == "extend" and (not armed or row["due_ms"] is None):
                continue
            if armed:
                self._disarm(timer)
            if row["op"] != "cancel" and row["due_ms"] is not None:
                self.handle.registerTimer(row["due_ms"])
                self.armed.updateValue((timer,), (row["kind"], row["due_ms"], row["attempt"], row["seq"]))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentProcessingTimeInMs()
        for timer in sorted(self._names()):
            kind, due, attempt, seq = self.armed.getValue((timer,))
            if due <= at:
                self.armed.removeKey((timer,))
                yield Row(activity_id=key[0], timer=timer, kind=kind, due_ms=due, attempt=attempt, fired_ms=now, seq=seq)

    def close(self) -> None:
        pass


def fired(commands: DataFrame) -> DataFrame:
    """A stream of timers as they fire, from a stream of commands."""
    keyed_state(commands.sparkSession)
    return commands.groupBy("activity_id").transformWithState(Timers(), FIRED, "Update", "ProcessingTime")


def follow(spark: SparkSession, path: str, after: int | str = 0) -> DataFrame:
    """Timers of all activities of a log as they fire: delays, retries, sleeps and leases."""
    return fired(T.commands(commits.follow(spark, path, "activities", after)))
