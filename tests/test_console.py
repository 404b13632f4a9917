"""Inspector, HTTP pages, hub and pools."""

from __future__ import annotations

import json
import queue
import threading
import urllib.error
import urllib.request
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pools as P
from tidemark.operators.inspector import Inspector
from tidemark.sources import lift as L
from tidemark.streaming import events as E
from tidemark.streaming.http import paging, serve

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inspector(spark):
    get = lambda f: lambda: f(spark, SF)
    return Inspector("main", {"activities": get(L.activities), "results": get(L.results), "events": get(L.events), "keys": get(L.idempotency), "pools": get(L.worker_pools)}, 7, lambda: datetime(1999, 1, 1))


def test_pages(inspector):
    server = serve(inspector, as_id=int)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def get(path):
        try:
            with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}{path}") as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    status, stats = get("/api/observability/stats")
    assert status == 200 and stats["max_workers"] > 0 and stats == inspector.stats()
    status, roots = get("/roots?status=failed&limit=3&offset=x")
    assert status == 200 and 0 < len(roots) <= 3 and {r["status"] for r in roots} == {"Failed"}
    key = roots[0]["id"]
    assert get(f"/activities/{key}")[1]["id"] == key
    assert {r["root_activity_id"] for r in get(f"/activities/{key}/subtree")[1]} <= {key, None}
    assert get("/activities/5/result")[0] == 404 and get("/activities/x")[0] == 400 and get("/roots?status=odd")[0] == 400 and get("/nothing")[0] == 404
    server.shutdown()


def test_paging():
    assert paging({}) == (0, 50) and paging({"offset": ["-1"], "limit": ["0"]}) == (0, 50) and paging({"offset": ["7"], "limit": ["99999"]}) == (7, 1000)


def test_hub_drops_for_slow_readers_alone(spark, tmp_path):
    hub = E.Hub(spark, str(tmp_path), str(tmp_path / "c"), buffer=2, most=2)
    hub._start = lambda: None
    (a, slow), (b, fast) = hub.subscribe(), hub.subscribe()
    with pytest.raises(RuntimeError):
        hub.subscribe()
    hub.publish([{"id": 1}, {"id": 2}])
    assert [fast.get_nowait()["id"] for _ in range(2)] == [1, 2]
    hub.publish([{"id": 3}])
    assert fast.get_nowait()["id"] == 3 and [slow.get_nowait()["id"] for _ in range(2)] == [1, 2]
    with pytest.raises(queue.Empty):
        slow.get_nowait()
    hub.leave(a), hub.leave(b)
    assert E.frame(None) == ": ping\n\n" and E.frame({"id": 1}) == 'data: {"id":1}\n\n'


def test_stream_reads_each_event_once(spark, tmp_path):
    rows = lambda lo, hi: L.events(spark, SF).filter((F.col("id") >= lo) & (F.col("id") < hi)).write.mode("append").parquet(str(tmp_path / "log"))
    rows(0, 100)
    q = E.stream(spark, str(tmp_path / "log"), cursor=49, schema=E.SCHEMA.replace("activity_id string", "activity_id long")).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    rows(100, 150)
    q.processAllAvailable()
    q.stop()
    assert sorted(r["id"] for r in spark.table("seen").collect()) == list(range(50, 150))


def test_pools(spark):
    at = lambda s: F.lit(f"2024-01-01 00:00:{s:02}").cast("timestamp_ntz")
    new = spark.createDataFrame([(1, "q", 5, ["a"]), (2, "q", 6, None)], "pool_id int, queue_name string, max_workers int, activity_types array<string>")
    first = P.registered(new, at(0))
    beats = first.unionByName(P.heartbeat(P.current(first), new.filter("pool_id = 1"), at(10)))
    beats = beats.unionByName(P.deregistered(P.current(first), new.filter("pool_id = 2"), at(5)))
    assert [(r["pool_id"], r["last_seen_at"]) for r in P.current(beats).collect()] == [(1, datetime(2024, 1, 1, 0, 0, 10))]
