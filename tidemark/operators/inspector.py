"""One object with every inspection of a queue, over whatever gives its tables."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import inspect as I

STATS_SECONDS = 1.0


class Inspector:
    """tables: functions that give the DataFrames activities, results, events, keys and pools, called anew each time."""

    def __init__(self, queue: str, tables: dict[str, Callable[[], DataFrame]], local_workers: int | None = None, now: Callable[[], datetime] | None = None):
        self.queue, self.tables, self.local_workers = queue, tables, local_workers
        self.now = now or (lambda: datetime.now(timezone.utc).replace(tzinfo=None))
        self._stats: tuple[float, dict] | None = None

    def _as_of(self):
        return F.lit(self.now().isoformat(sep=" ")).cast("timestamp_ntz")

    def _acts(self) -> DataFrame:
        return self.tables["activities"]()

    def stats(self) -> dict:
        """At most a second old; without live pools the local number of workers stands in."""
        if self._stats is None or time.monotonic() - self._stats[0] > STATS_SECONDS:
            row = I.stats(self._acts(), self.tables["pools"](), self.queue, self._as_of()).first().asDict()
            row["max_workers"] = row["max_workers"] or self.local_workers
            self._stats = (time.monotonic(), row)
        return dict(self._stats[1])

    def pending(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.by_status(self._acts(), self.queue, "pending", offset, limit)

    def processing(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.by_status(self._acts(), self.queue, "processing", offset, limit)

    def scheduled(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.scheduled(self._acts(), self.queue, offset, limit)

    def completed(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.completed(self._acts(), self.queue, False, offset, limit)

    def completed_cron(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.completed(self._acts(), self.queue, True, offset, limit)

    def dead_letters(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.dead_letters(self._acts(), self.queue, self._as_of(), offset, limit)

    def cron(self, offset=0, limit=I.PAGE) -> DataFrame:
        return I.cron(self._acts(), self.queue, offset, limit)

    def roots(self, status=None, offset=0, limit=I.PAGE) -> DataFrame:
        return I.recent(self._acts(), self.queue, status, True, offset, limit)

    def recent(self, status=None, offset=0, limit=I.PAGE) -> DataFrame:
        return I.recent(self._acts(), self.queue, status, False, offset, limit)

    def activity(self, activity_id) -> DataFrame:
        return I.activity(self._acts(), self.queue, activity_id)

    def result(self, activity_id) -> DataFrame:
        return I.result(self.tables["results"](), activity_id)

    def events(self, activity_id, limit=I.PAGE) -> DataFrame:
        return I.activity_events(self.tables["events"](), activity_id, limit)

    def steps(self, activity_id) -> DataFrame:
        return I.activity_steps(self.tables["results"](), activity_id)

    def children(self, activity_id, offset=0, limit=I.PAGE) -> DataFrame:
        return I.children(self._acts(), self.queue, activity_id, offset, limit)

    def subtree(self, activity_id) -> DataFrame:
        return I.subtree(self._acts(), self.queue, activity_id)
