"""Idempotency keys as keyed state: claims are resolved as they arrive, within a batch and across batches.

The batch operator is transitions.resolve_keys; both give the same rows for the same claims.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.streaming import keyed_state

#: What comes in. ``claim``: an activity asks for the key, by a behaviour. ``failed``: it ended in failure. ``gone``: it was deleted, the key was not.
#: ``swept``: activity and key are deleted.
EVENT = "queue_name string, idempotency_key string, what string, id string, behaviour string, created_at timestamp_ntz"
RESOLVED = "queue_name string, idempotency_key string, id string, action string, activity_id string"


class Keys(StatefulProcessor):
    """Who holds a key: the state of one (queue_name, idempotency_key), kept until a sweep takes it away."""

    def init(self, handle) -> None:
        self.holder = handle.getValueState("holder", "id string, failed boolean, gone boolean")

    def _claimed(self, row) -> tuple[str, str | None]:
        """Action and activity of a claim; the holder is set anew where it takes the key."""
        held = self.holder.get() if self.holder.exists() else None
        behaviour = row["behaviour"]
        if held is None:
            action = "enqueue"
        elif held[2]:
            action = "reclaim"
        elif behaviour == "return_existing":
            return "return", held[0]
        elif behaviour == "allow_reuse" or (behaviour == "allow_reuse_on_failure" and held[1]):
            action = "reuse"
        else:
            return {"no_reuse": "duplicate", "allow_reuse_on_failure": "conflict"}[behaviour], None
        self.holder.update((row["id"], False, False))
        return action, row["id"]

    def handleInputRows(self, key, rows, timerValues):
        for row in sorted(rows, key=lambda r: (r["created_at"] or datetime.min, r["id"])):
            if row["what"] == "claim":
                action, activity = self._claimed(row)
                yield Row(queue_name=key[0], idempotency_key=key[1], id=row["id"], action=action, activity_id=activity)
            elif self.holder.exists() and self.holder.get()[0] == row["id"]:  # what became of an earlier holder changes nothing
                if row["what"] == "swept":
                    self.holder.clear()
                else:
                    held = self.holder.get()
                    self.holder.update((held[0], held[1] or row["what"] == "failed", held[2] or row["what"] == "gone"))

    def handleInitialState(self, key, initialState, timerValues):
        self.holder.update((initialState["activity_id"], initialState["failed"], initialState["gone"]))

    def close(self) -> None:
        pass


def held(keys: DataFrame, activities: DataFrame) -> DataFrame:
    """The state to begin with: stored keys, and whether their activities failed or are gone."""
    state = activities.select(F.col("id").alias("activity_id"), "status")
    found = keys.select("queue_name", "idempotency_key", "activity_id").join(state, "activity_id", "left")
    failed = F.coalesce(F.col("status").isin("failed", "dead_letter"), F.lit(False))
    return found.select("queue_name", "idempotency_key", F.col("activity_id").cast("string").alias("activity_id"), failed.alias("failed"), F.col("status").isNull().alias("gone"))


def resolved(events: DataFrame, initial: DataFrame | None = None) -> DataFrame:
    """A stream of what becomes of claims, from a stream of EVENT rows; initial: rows of held(), used when the query starts for the first time.

    Rows of one micro-batch count in order of (created_at, id), batches as they come.
    """
    key = ["queue_name", "idempotency_key"]
    keyed_state(events.sparkSession)
    start = None if initial is None else initial.groupBy(*key)
    return events.groupBy(*key).transformWithState(Keys(), RESOLVED, "Update", "None", start)
