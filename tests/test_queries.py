"""Every query of the queue against its SQL, and the scalar functions against literal values."""

from __future__ import annotations

import importlib.util
import uuid
from datetime import datetime
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import transitions as T
from tidemark.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return v.isoformat() if isinstance(v, datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(plans.ORACLE_SQL[name])
    names = want.columns
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in want.fetchall())


def test_scalars(spark):
    cases = [(1, 0, 3600, 2), (1, 3, 3600, 16), (1, 11, 3600, 3600), (1, 100, 0, 3600), (60, 5, 3600, 3600), (0, 3, 3600, 0), (9223372036, 62, 9223372036854775807, 9223372036)]
    df = spark.createDataFrame(cases, "b long, r int, cap long, want long")
    assert all(r[0] == r[1] for r in df.select(S.retry_delay_seconds("b", "r", "cap"), "want").collect())
    ns = str(uuid.uuid4())
    names = ["run:a", "sleep:é", ""]
    ids = spark.createDataFrame([(n,) for n in names], "n string").select(S.checkpoint_id(F.lit(ns), "n")).collect()
    assert [r[0] for r in ids] == [str(uuid.uuid5(uuid.UUID(ns), n)) for n in names]
    keys = spark.createDataFrame([("rq:step:1:2:a:b",), ("x",), (None,)], "k string").select(S.step_label("k")).collect()
    assert [r[0] for r in keys] == ["a:b", None, None]
    names = spark.createDataFrame([("a" * 48,), ("a" * 49,), ("1a",), ("_1",), ("",), (None,), ("a-b",)], "n string").select(S.valid_queue_name("n")).collect()
    assert [r[0] for r in names] == [True, False, False, True, False, False, False]
    p = spark.createDataFrame([(0,), (1,), (4,), (5,)], "p int").select(S.clamp_priority("p")).collect()
    assert [r[0] for r in p] == [1, 1, 4, 2]


def test_reaper_script(spark):
    """Two attempts allowed: the first expiry requeues, the second kills; both count."""
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    row = "id long, status string, retry_count int, max_retries int, lease_deadline_ms long, current_worker_id string, parent_activity_id long"
    first = T.reap(spark.createDataFrame([(1, "processing", 0, 2, 0, "w", None)], row), now).first()
    assert (first["status"], first["retry_count"], first["event_type"]) == ("pending", 1, "Requeued")
    second = T.reap(spark.createDataFrame([(1, "processing", 1, 2, 0, "w", None)], row), now).first()
    assert (second["status"], second["retry_count"], second["event_type"], second["state"]) == ("dead_letter", 2, "DeadLetter", "Err")


def test_delay_is_not_woken(spark):
    acts = spark.createDataFrame([(1, "scheduled"), (2, "waiting")], "id long, status string")
    assert [r["id"] for r in T.wake(acts, acts).collect()] == [2]


def test_nothing_outside_imports_llm():
    root = Path(importlib.util.find_spec("tidemark").submodule_search_locations[0])
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tidemark.llm" not in path.read_text(), path
