"""The engine over its log, with literal cases: retries, dead letters, steps, sleeps, signals, children, keys, leases, sweeps."""

from __future__ import annotations

import json
import threading
import time
from datetime import datetime, timedelta

import pytest

from tidemark.operators.inspector import Inspector
from tidemark.sources.log import Log
from tidemark.streaming import events as E
from tidemark.streaming.engine import Engine
from tidemark.streaming.handlers import Context, Handler, HandlerError, Permanent, Request, SignalTimeout, Yield, attempt, checkpoint_id

NOW = datetime(2024, 1, 1)
ROW = {"id": "6ba7b810-9dad-11d1-80b4-00c04fd430c8", "activity_type": "t", "retry_count": 0, "root_activity_id": None, "depth": 0, "metadata": None, "timeout_seconds": 300, "payload": "1"}


class Child(Handler):
    activity_type = "child"

    def handle(self, ctx, payload):
        return payload * 2


class Parent(Handler):
    activity_type = "parent"

    def handle(self, ctx, payload):
        futures = [ctx.start(Request("child", n).step(f"c{n}")) for n in payload]
        return sum(ctx.wait_all(futures))


class Flaky(Handler):
    activity_type = "flaky"

    def handle(self, ctx, payload):
        ctx.run("once", lambda: 1)
        raise HandlerError('no "such" thing\n') if payload == "retry" else Permanent("never")


class Waits(Handler):
    activity_type = "waits"

    def handle(self, ctx, payload):
        ctx.sleep("nap", 60)
        return ctx.wait_for_signal("go", 600)


def one(handler, memo=None, results=None, now=NOW, **row):
    return attempt({handler.activity_type: handler}, ROW | {"activity_type": handler.activity_type} | row, memo if memo is not None else {}, results or {}, now)


def test_run_is_remembered_and_retryable_failures_are_not():
    calls = []
    memo: dict = {}
    ctx = Context(ROW, memo, {}, NOW)
    assert [ctx.run("a", lambda: calls.append(1) or 7) for _ in range(2)] == [7, 7] and calls == [1]
    with pytest.raises(HandlerError):
        ctx.run("b", lambda: (_ for _ in ()).throw(HandlerError("x")))
    assert "run:b" not in memo
    with pytest.raises(Permanent):
        ctx.run("c", lambda: (_ for _ in ()).throw(Permanent("y")))
    assert memo["run:c"] == ("Err", '"y"')
    with pytest.raises(Permanent):
        ctx.run("", lambda: 1)


def test_sleep_and_signal():
    memo: dict = {}
    done = one(Waits(), memo)
    assert done["outcome"] == "yield" and done["wake_at"] == NOW + timedelta(seconds=60) and done["kind"] == "sleep"
    done = one(Waits(), memo, now=NOW + timedelta(seconds=61))
    assert done["kind"] == "signal" and done["wake_at"] == NOW + timedelta(seconds=661)
    late = one(Waits(), dict(memo), now=NOW + timedelta(seconds=700))
    assert late["outcome"] == "non_retryable"
    # a signal that has come wins over the timeout
    assert one(Waits(), memo | {"signal:go": ("Ok", "5")}, now=NOW + timedelta(seconds=700))["data"] == "5"
    with pytest.raises(SignalTimeout):
        Context(ROW, {"signalwait:x": ("Ok", f'"{NOW.isoformat()}"')}, {}, NOW).wait_for_signal("x", 1)
    with pytest.raises(Yield):
        Context(ROW, {}, {}, NOW).wait_for_signal("x")


def test_requests_are_checked():
    for bad in (lambda: Request("t").checked(False), lambda: Request("t", 1).step("s").checked(False), lambda: Request("t", 1).step("s").key("k").checked(True), lambda: Request("t", 1).timeout(0.5)):
        with pytest.raises(ValueError):
            bad()
    assert one(Child(), activity_type="other")["outcome"] == "non_retryable"


def test_engine(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    engine = Engine(log, "main", [Parent(), Child(), Flaky(), Waits()], slots=10)
    with pytest.raises(ValueError):
        Engine(log, "main", [], types=["x"])
    parent, flaky, never, waits = engine.enqueue([Request("parent", [1, 2]), Request("flaky", "retry").max_retries(2), Request("flaky", "never"), Request("waits", 0).key("w")], NOW)
    assert engine.enqueue([Request("waits", 0).key("w")], NOW) == [waits]
    assert engine.tick(NOW) == 4
    status = lambda: {r["id"]: r["status"] for r in log.latest("activities").collect()}
    first = status()
    assert first[parent] == "waiting" and first[flaky] == "retrying" and first[never] == "failed" and first[waits] == "waiting"
    assert len(first) == 6  # two children
    assert engine.tick(NOW + timedelta(seconds=1)) == 2  # children; the retry is not due
    assert engine.tick(NOW + timedelta(seconds=3)) == 2  # the parent, woken, and the retry
    assert status()[parent] == "completed" and engine.result(parent) == ("Ok", "6")
    assert status()[flaky] == "dead_letter" and engine.result(flaky)[0] == "Err"
    assert engine.tick(NOW + timedelta(seconds=61)) == 1
    assert engine.signal_by_key("waits", "w", "go", {"ok": 1}, NOW + timedelta(seconds=62))
    assert not engine.signal("nobody", "go", 1, NOW)
    assert engine.tick(NOW + timedelta(seconds=63)) == 1
    assert engine.result(waits) == ("Ok", '{"ok": 1}') == engine.wait_for_result(waits, 1)
    error = json.loads(engine.result(flaky)[1])
    assert error == {"error": 'no "such" thing\n', "type": "dead_letter", "failed_at": "2024-01-01T00:00:03Z"}
    # inspection, events and steps over the engine's own log
    see = Inspector("main", log.tables(), now=lambda: NOW)
    assert [r["event_type"] for r in see.events(flaky).collect()] == ["Enqueued", "Dequeued", "Retrying", "Dequeued", "DeadLetter"]
    assert [(r["kind"], r["name"]) for r in see.steps(flaky).collect()] == [("run", "once")]
    assert see.stats()["dead_letter"] == 1 and see.subtree(parent).count() == 3
    stored = log.latest("events").filter("event_type = 'ResultStored'").collect()
    assert checkpoint_id(flaky, "run", "once") in {r["activity_id"] for r in stored}
    assert log.latest("events").select("id").distinct().count() == log.latest("events").count()
    assert engine.sweep(NOW + timedelta(hours=2), completed_ttl=3600) == 2
    left = status()
    assert parent not in left and waits not in left and len(left) == 2
    assert set(log.latest("events").filter("event_type <> 'ResultStored'").select("activity_id").distinct().toPandas()["activity_id"]) == set(left)
    assert log.compact(str(tmp_path / "new")).latest("activities").count() == 2


class Hangs(Handler):
    activity_type = "hangs"

    def handle(self, ctx, payload):
        ctx.run("before", lambda: 1)
        time.sleep(30)


def test_a_hanging_handler_is_left_at_its_timeout():
    began = time.monotonic()
    done = one(Hangs(), timeout_seconds=1)
    assert time.monotonic() - began < 5 and done["outcome"] == "retryable" and done["error"] == "timeout" and done["memo"][0][0] == "run:before"


def test_children_nested_too_deep_are_an_error_to_the_handler():
    done = one(Parent(), payload="[1]", depth=32)
    assert done["outcome"] == "non_retryable" and "32" in done["error"] and not done["spawns"]


class Crash(Exception):
    pass


def test_a_crash_between_any_two_writes_loses_nothing(spark, tmp_path, monkeypatch):
    """A batch is cut off before its first write, its second ..., its commit: afterwards the work is done all the same, once."""
    log = Log(spark, str(tmp_path / "log"))
    engine = Engine(log, "main", [Parent(), Child()], slots=10)
    (parent,) = engine.enqueue([Request("parent", [1]).max_retries(0)], NOW)
    crashed, now = 0, NOW
    reader = type(spark.range(0).write)
    parquet = reader.parquet
    for cut in range(5):
        count = {"n": 0}

        def counted(self, path, *a, count=count, cut=cut, **k):
            if str(tmp_path / "log") in path and "_outcomes" not in path:
                if count["n"] == cut:
                    raise Crash
                count["n"] += 1
            return parquet(self, path, *a, **k)

        settle = engine._settle
        monkeypatch.setattr(engine, "_settle", lambda done, at, f=settle, c=counted: (monkeypatch.setattr(reader, "parquet", c), f(done, at))[1])
        try:
            engine.tick(now)
        except Crash:
            crashed += 1
        monkeypatch.setattr(reader, "parquet", parquet)
        monkeypatch.setattr(engine, "_settle", settle)
        assert {r["id"]: r["status"] for r in log.latest("activities").collect()} == {parent: "processing"}
        now += timedelta(seconds=400)  # the lease has run out
    assert crashed == 5
    for _ in range(4):
        engine.tick(now)
        now += timedelta(seconds=1)
    rows = log.latest("activities").collect()
    assert sorted(r["status"] for r in rows) == ["completed", "completed"] and engine.result(parent) == ("Ok", "2")
    ended = log.latest("events").filter("event_type = 'Completed'").collect()
    assert len(ended) == 2


def test_engines_share_a_queue(spark, tmp_path):
    """Two engines, each with its own view of the log, drain 200 activities once each."""
    path = str(tmp_path / "log")
    engines = [Engine(Log(spark, path), "main", [Child()], slots=60) for _ in range(2)]
    ids = engines[0].enqueue([Request("child", n) for n in range(200)], NOW)

    def drain(engine):
        while engine.tick(NOW):
            pass

    threads = [threading.Thread(target=drain, args=(e,)) for e in engines]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = engines[0].log
    assert {r["id"]: r["status"] for r in log.latest("activities").collect()} == dict.fromkeys(ids, "completed")
    claims = log.latest("events").filter("event_type = 'Dequeued'")
    assert claims.count() == claims.select("activity_id").distinct().count() == 200
    assert sum(e.counters["claimed"] for e in engines) == 200


class Slow(Handler):
    activity_type = "slow"

    def handle(self, ctx, payload):
        time.sleep(2)
        return payload


def test_a_running_engine_drains_when_it_stops(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    engine = Engine(log, "main", [Slow()], slots=3)
    hub = E.Hub(spark, f"{log.path}/events", str(tmp_path / "hub"))
    _, heard = hub.subscribe()
    (key,) = engine.enqueue([Request("slow", 7)])
    engine.start(str(tmp_path / "c"), "100 milliseconds")
    until = time.monotonic() + 60
    while not log.latest("activities").filter("status = 'processing'").count() and time.monotonic() < until:
        time.sleep(0.1)
    assert log.latest("pools").first()["max_workers"] == 3
    assert engine.stop(60) and engine.stop()
    assert engine.result(key) == ("Ok", "7") and log.latest("pools").count() == 0
    assert heard.get(timeout=30)["event_type"] == "Enqueued" and heard.get(timeout=30)["activity_id"] == key
    hub.leave(1)


def test_leases_are_extended(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"))
    engine = Engine(log, "main", [Child()], slots=3)
    (key,) = engine.enqueue([Request("child", 1)], NOW)
    assert not engine.extend_lease(key, 60, NOW)
    with log.exclusive():
        engine._claim(NOW)
    assert engine.extend_lease(key, 7200, NOW)
    late = NOW + timedelta(seconds=3600)
    assert engine.tick(late) == 0 and log.latest("activities").first()["status"] == "processing"


def test_one_writer_at_a_time(spark, tmp_path):
    logs = [Log(spark, str(tmp_path / "log")) for _ in range(4)]
    inside, most, turns = [], [], []

    def write(log):
        for _ in range(25):
            with log.exclusive():
                inside.append(1)
                most.append(len(inside))
                time.sleep(0.001)
                inside.pop()
                turns.append(1)

    threads = [threading.Thread(target=write, args=(log,)) for log in logs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert max(most) == 1 and len(turns) == 100
    with logs[0].exclusive(), pytest.raises(TimeoutError), logs[1].exclusive(patience=0.2):
        pass
    with logs[0].exclusive(), logs[1].exclusive(stale=-1):
        pass  # one left by a crash is broken
