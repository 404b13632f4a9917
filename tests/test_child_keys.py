"""Children under keys that others hold, the counters of an engine, and a late acknowledgement of the same worker."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import transitions as T
from tidemark.sources import commits
from tidemark.sources.log import Log
from tidemark.streaming import metrics as M
from tidemark.streaming.engine import Engine
from tidemark.streaming.handlers import Handler, Permanent, Request

NOW = datetime(2024, 1, 1)


class Child(Handler):
    activity_type = "child"

    def handle(self, ctx, payload):
        return payload * 2


class Starts(Handler):
    """Starts a child under a key, by the behaviour that it is given."""

    activity_type = "starts"

    def handle(self, ctx, payload):
        try:
            return ctx.result(ctx.start(Request("child", 5).key("shared", payload)))
        except Permanent as e:
            return f"refused: {e}"


def test_a_held_key_gives_the_held_child(spark, tmp_path):
    log, seen = Log(spark, str(tmp_path / "log")), Counter()
    engine = Engine(log, "main", [Child(), Starts()], slots=10, metrics=lambda name, n: seen.update({name: n}))
    (held,) = engine.enqueue([Request("child", 21).key("shared")], NOW)
    returns, refused = engine.enqueue([Request("starts", "return_existing"), Request("starts", "no_reuse")], NOW)
    assert engine.tick(NOW) == 3
    children = log.latest("activities").filter("activity_type = 'child'")
    assert [r["id"] for r in children.collect()] == [held]  # no second child
    assert log.latest("keys").first()["activity_id"] == held  # and the key was not taken over
    linked = log.latest("events").filter("event_type = 'SpawnLinked'").collect()
    assert [(r["activity_id"], r["detail"]) for r in linked] == [(held, f'{{"parent_id":"{returns}"}}')]
    assert engine.tick(NOW + timedelta(seconds=6)) == 2  # one has its result, one its refusal
    assert engine.result(returns) == ("Ok", "42") and engine.result(refused) == ("Ok", '"refused: duplicate"')
    assert engine.counters["activity_completed"] == seen["activity_completed"] == 3 and seen["activity_yielded"] == 2 and engine.counters["claimed"] == 5
    # the same counts from the log alone, as a stream
    listener = M.Counters()
    spark.streams.addListener(listener)
    try:
        q = M.observed_stream(commits.follow(spark, log.path, "events")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.total == {"activity_completed": 3, "activity_yielded": 2}


def test_an_earlier_attempt_of_the_same_worker_is_late(spark):
    acts = spark.createDataFrame([("a", "processing", "w", 2, "p"), ("b", "completed", "w", 1, None)], "id string, status string, current_worker_id string, attempt int, parent_activity_id string")
    sent = [("a", "w", 1, 1), ("a", "w", 2, 2), ("a", "w", 2, 3), ("a", "v", 2, 4), ("a", "w", None, 5), ("a", "w", 3, 6), ("b", "w", 1, 7), ("c", "w", 1, 8), (None, "w", 1, 9)]
    commands = spark.createDataFrame([(*r, "success", str(r[3])) for r in sent], "id string, worker_id string, attempt int, seq long, outcome string, data string")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    assert [(r["id"], r["data"]) for r in T.ack_success(acts, commands, now).collect()] == [("a", "2")]
    why = {r["seq"]: r["reason"] for r in T.stale_acks(acts, commands).collect()}
    assert why == {1: "late", 3: "repeated", 4: "foreign", 5: "late", 6: "early", 7: "ended", 8: "unknown", 9: "unknown"}
