"""Keys claimed as a stream: the batch resolver's rows within a batch and across batches, until a sweep."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tidemark.operators import transitions as T
from tidemark.streaming import keys as K

NOW = datetime(2024, 1, 1)
ACTS = [("old-ok", "completed"), ("old-bad", "dead_letter"), ("old-open", "pending")]
HELD = [("q", "ok", "old-ok"), ("q", "bad", "old-bad"), ("q", "open", "old-open"), ("q", "orphan", "nobody")]


class Claims:
    def __init__(self, spark, tmp_path, initial):
        self.spark, self.path, self.checkpoint, self.initial = spark, str(tmp_path / "events"), str(tmp_path / "checkpoint"), initial
        self.out: list = []

    def give(self, rows):
        self.spark.createDataFrame(rows, K.EVENT).repartition(3).write.mode("append").parquet(self.path)

    def run(self):
        """All that has come, in one query of its own: state comes from the checkpoint."""
        stream = self.spark.readStream.schema(K.EVENT).parquet(self.path)
        seen = []
        q = K.resolved(stream, self.initial).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(tuple(r) for r in df.collect())).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(seen)


def tables(spark):
    return spark.createDataFrame(HELD, "queue_name string, idempotency_key string, activity_id string"), spark.createDataFrame(ACTS, "id string, status string")


@pytest.mark.parametrize("seed", [1, 2])
def test_a_stream_resolves_as_a_batch(spark, tmp_path, seed):
    """Mixed behaviours on shared keys, shuffled; then half of them in a second run."""
    rng, (keys, acts) = random.Random(seed), tables(spark)
    rows = [("q", rng.choice(["ok", "bad", "open", "orphan", "new", "other"]), "claim", f"c{n:03}", rng.choice(T.BEHAVIOURS), NOW + timedelta(seconds=n // 3)) for n in range(120)]
    claims = spark.createDataFrame(rows, K.EVENT)
    want = sorted(tuple(r) for r in T.resolve_keys(claims, keys, acts).select("queue_name", "idempotency_key", "id", "action", "activity_id").collect())
    assert {r[3] for r in want} == {"enqueue", "reclaim", "return", "reuse", "conflict", "duplicate"}
    stream, mixed = Claims(spark, tmp_path, K.held(keys, acts)), list(rows)
    first, second = mixed[:60], mixed[60:]
    rng.shuffle(first), rng.shuffle(second)
    stream.give(first)
    got = stream.run()
    stream.give(second)
    got += stream.run()
    assert sorted(got) == want


def test_one_behaviour_for_all(spark):
    keys, acts = tables(spark)
    rows = [("q", k, "claim", f"{k}{n}", None, NOW) for k in ("ok", "bad", "orphan", "new") for n in range(3)]
    claims = spark.createDataFrame(rows, K.EVENT).drop("behaviour")
    for b in T.BEHAVIOURS:
        got = {r["id"]: (r["action"], r["activity_id"]) for r in T.resolve_keys(claims, keys, acts, b).collect()}
        assert got["new0"] == ("enqueue", "new0") and got["orphan0"] == ("reclaim", "orphan0")
        assert got["bad2"] == {"return_existing": ("return", "old-bad"), "allow_reuse": ("reuse", "bad2"), "allow_reuse_on_failure": ("conflict", None), "no_reuse": ("duplicate", None)}[b]
        assert got["new1"] == {"return_existing": ("return", "new0"), "allow_reuse": ("reuse", "new1"), "allow_reuse_on_failure": ("conflict", None), "no_reuse": ("duplicate", None)}[b]
    with pytest.raises(ValueError):
        T.resolve_keys(claims, keys, acts, "odd")


def test_until_it_is_swept(spark, tmp_path):
    stream = Claims(spark, tmp_path, None)
    step = iter(range(100))

    def row(key, what, id, behaviour=None):
        return ("q", key, what, id, behaviour, NOW + timedelta(seconds=next(step)))

    stream.give([row("k", "claim", "a", "no_reuse"), row("k", "claim", "b", "allow_reuse_on_failure"), row("k", "failed", "x"), row("k", "failed", "a"), row("k", "claim", "c", "allow_reuse_on_failure")])
    assert [r[2:] for r in stream.run()] == [("a", "enqueue", "a"), ("b", "conflict", None), ("c", "reuse", "c")]
    stream.give([row("k", "failed", "a"), row("k", "swept", "a"), row("k", "claim", "d", "allow_reuse_on_failure")])  # not the holder any more
    assert [r[2:] for r in stream.run()] == [("d", "conflict", None)]
    stream.give([row("k", "gone", "c"), row("k", "claim", "e", "no_reuse"), row("k", "swept", "e"), row("k", "claim", "f", "no_reuse")])
    assert [r[2:] for r in stream.run()] == [("e", "reclaim", "e"), ("f", "enqueue", "f")]


def test_fresh_keys_meet_no_activity(spark):
    """Claims are joined by key alone, in as many parts as asked for; a null activity of a stored key counts as none."""
    keys, acts = tables(spark)
    keys = keys.unionByName(spark.createDataFrame([("q", "empty", None)], keys.schema))
    rows = [("q", k, "claim", f"{k}-{n}", None, NOW) for k in ("ok", "orphan", "empty", *(f"new{i}" for i in range(200))) for n in range(2)]
    claims = spark.createDataFrame(rows, K.EVENT).drop("behaviour")
    plain, dealt = (T.resolve_keys(claims, keys, acts, "no_reuse", parts) for parts in (None, 13))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, dealt.collect()))
    assert dealt.rdd.getNumPartitions() == 13
    assert {r["id"]: r["action"] for r in dealt.collect() if r["id"].startswith("empty")} == {"empty-0": "enqueue", "empty-1": "duplicate"}
    for found in (plain, dealt):
        plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
        at = next(i for i, line in enumerate(plan) if "Join LeftOuter, (held_id" in line)
        assert any("Join LeftSemi" in line for line in plan[at:])  # only claimed keys look for their activity
        assert not any("Join LeftOuter" in line for line in plan[at + 1 :])
