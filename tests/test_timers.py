"""Timers: the batch operator against a step-by-step model, the stream with restarts and leases that move."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import timers as T
from tidemark.sources.log import Log
from tidemark.streaming import timers
from tidemark.streaming.engine import Engine
from tidemark.streaming.handlers import Handler, Request


def model(commands, as_of):
    """Plays commands one after the other."""
    out, armed = [], {}

    def until(now, key, strictly=True):
        if key in armed:
            fires, row = armed[key]
            if fires < now or (not strictly and fires <= now):
                out.append((*key, row[3], row[4], row[5], fires, row[7]))
                del armed[key]

    for row in sorted((c for c in commands if c[6] is not None), key=lambda c: (c[6], c[7])):
        key, op, due, at = (row[0], row[1]), row[2], row[4], row[6]
        until(at, key)
        if op == "cancel" or (op == "set" and due is None):
            armed.pop(key, None)
        elif due is not None and (op == "set" or key in armed):
            armed[key] = (max(due, at), row)
        elif op == "extend" and key in armed:
            del armed[key]
    for key in list(armed):
        until(as_of, key, strictly=False)
    return sorted(r for r in out if r[5] <= as_of)


def test_fired_as_played_step_by_step(spark):
    rng = random.Random(5)
    rows = [(f"a{rng.randrange(9)}", rng.choice(["wake", "lease"]), rng.choice(["set", "extend", "extend", "cancel"]), "k", (at := rng.randrange(400)) + rng.randrange(-3, 40), rng.randrange(3), at, n) for n in range(900)]
    rows.append(("a0", "wake", "set", "k", 7, 1, None, 900))
    rng.shuffle(rows)
    got = T.fired(spark.createDataFrame(rows, T.COMMAND).repartition(5), F.lit(350))
    want = model(rows, 350)
    assert want and sorted(tuple(r) for r in got.collect()) == want
    assert not T.fired(spark.createDataFrame([], T.COMMAND), F.lit(1)).collect()


def test_commands_of_states(spark):
    rows = [("a", "waiting", datetime(2024, 1, 1), None, 1, 1), ("a", "processing", None, 5000, 2, 2), ("a", "completed", None, None, 2, 3), ("b", "pending", datetime(2024, 1, 1), 7, 0, 4)]
    df = spark.createDataFrame(rows, "id string, status string, scheduled_at timestamp_ntz, lease_deadline_ms long, attempt int, seq long")
    got = sorted(tuple(r) for r in T.commands(df).select("seq", "timer", "op", "kind", "due_ms", "attempt").collect())
    new_year = 1704067200000
    assert got == [
        (1, "lease", "cancel", None, None, 1), (1, "wake", "set", "sleep", new_year, 1), (2, "lease", "set", "lease", 5000, 2), (2, "wake", "cancel", None, None, 2),
        (3, "lease", "cancel", None, None, 2), (3, "wake", "cancel", None, None, 2), (4, "lease", "cancel", None, None, 0), (4, "wake", "cancel", None, None, 0),
    ]


class Feed:
    """A stream of commands from files, and what fires. Each run is one batch of a query that starts from the checkpoint."""

    def __init__(self, spark, tmp_path):
        self.spark, self.path, self.checkpoint, self.seq = spark, str(tmp_path / "commands"), str(tmp_path / "checkpoint"), 0

    def give(self, *rows):
        """(activity_id, timer, op, kind, due_ms), in this order."""
        full = [(*r, 1, None, self.seq + n) for n, r in enumerate(rows)]
        self.seq += len(rows)
        self.spark.createDataFrame(full, T.COMMAND).coalesce(1).write.mode("append").parquet(self.path)

    def run(self):
        batches = {}
        self.give(("nobody", "wake", "cancel", None, None))  # one batch alone needs something new to read
        stream = timers.fired(self.spark.readStream.schema(T.COMMAND).parquet(self.path))
        keep = lambda df, batch: batches.update({batch: df.collect()})
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", self.checkpoint).trigger(once=True).start()
        assert query.awaitTermination(100)
        rows = [r for batch in batches.values() for r in batch]
        assert all(r["fired_ms"] >= r["due_ms"] for r in rows)
        return sorted((r["activity_id"], r["timer"], r["kind"]) for r in rows)


def ms(seconds=0.0):
    return int((time.time() + seconds) * 1000)


def until(due):
    time.sleep(max(0.0, due / 1000 - time.time()) + 0.1)


def test_timers_survive_restarts(spark, tmp_path):
    feed, later = Feed(spark, tmp_path), ms(30)
    feed.give(("sleeps", "wake", "set", "sleep", later), ("retries", "wake", "set", "retry", ms(-5)), ("delayed", "wake", "set", "delay", later), ("gone", "wake", "set", "sleep", later), ("gone", "wake", "cancel", None, None))
    assert feed.run() == [("retries", "wake", "retry")]  # overdue: at once
    assert time.time() * 1000 < later
    until(later)  # nothing runs while the others fall due
    assert feed.run() == [("delayed", "wake", "delay"), ("sleeps", "wake", "sleep")]
    feed.give(("last", "wake", "set", "sleep", ms()))
    assert feed.run() == [("last", "wake", "sleep")]  # what has fired does not fire again


def test_leases_move(spark, tmp_path):
    """An extension takes the old deadline away; acknowledged leases never fire; an expired one can't be extended."""
    feed, soon, late = Feed(spark, tmp_path), ms(40), ms(55)
    feed.give(("extended", "lease", "set", "lease", soon), ("expires", "lease", "set", "lease", soon), ("acked", "lease", "set", "lease", soon), ("twice", "lease", "set", "lease", soon), ("twice", "wake", "set", "sleep", soon))
    assert feed.run() == []
    feed.give(("extended", "lease", "extend", "lease", late), ("acked", "lease", "cancel", None, None), ("twice", "lease", "cancel", None, None), ("never", "lease", "extend", "lease", soon))
    assert feed.run() == [] and time.time() * 1000 < soon
    until(soon)
    assert feed.run() == [("expires", "lease", "lease"), ("twice", "wake", "sleep")]  # one of two timers of a millisecond
    feed.give(("expires", "lease", "extend", "lease", ms(1)))
    until(late)
    assert feed.run() == [("extended", "lease", "lease")]


class Naps(Handler):
    activity_type = "naps"

    def handle(self, ctx, payload):
        ctx.sleep("nap", 3600)


def test_timers_of_a_log(spark, tmp_path):
    """The engine's own states: a sleep in the past of this clock fires, the lease of a parked activity doesn't."""
    log, seen = Log(spark, str(tmp_path / "log")), []
    engine, now = Engine(log, "main", [Naps()]), datetime(2024, 1, 1)
    (nap,) = engine.enqueue([Request("naps", 1)], now)
    engine.tick(now)
    keep = lambda df, _: seen.extend((r["activity_id"], r["timer"], r["kind"], r["due_ms"]) for r in df.collect())
    query = timers.follow(spark, log.path).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert query.awaitTermination(100)
    due = int(((now + timedelta(hours=1)) - datetime(1970, 1, 1)).total_seconds() * 1000)
    assert seen == [(nap, "wake", "sleep", due)]
