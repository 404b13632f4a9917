"""The engine: claims, runs handlers on the executors and appends what follows to the log.

Each tick reaps expired leases, claims the next activities, runs their handlers and appends results, events, children
and states as one batch: a crash leaves either all of it or nothing, and then the lease runs out and the
activities run again with the memos of earlier ticks. Several engines may share a log: they take turns
to write, and handlers run outside their turns. start() ticks from a Structured Streaming trigger.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import transitions as T
from tidemark.sources.log import Log
from tidemark.streaming.handlers import ALIAS, Handler, Request, attempt
from tidemark.streaming.metrics import Counters, observed

SPAWN = "array<struct<id:string,activity_type:string,payload:string,key:string,behaviour:string,parent:string,root:string,depth:int,priority:int,max_retries:int,timeout_seconds:bigint,delay_seconds:bigint,max_retry_delay_seconds:bigint,metadata:array<string>>>"
OUTCOME = f"id string, worker_id string, attempt int, outcome string, data string, error string, wake_at timestamp_ntz, kind string, step string, memo array<struct<step:string,state:string,data:string>>, spawns {SPAWN}"


def at(now: datetime):
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def utc_now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


#: Seconds between beats of a pool, and between sweeps; commits after which the log is folded.
BEAT_SECONDS, SWEEP_SECONDS, FOLD_COMMITS = 10, 600, 64
#: Seconds after which a handler that waits for another parent's child is run again.
LOOK_SECONDS = 5


class Engine:
    def __init__(self, log: Log, queue: str, handlers: list[Handler], slots: int = 10, types: list[str] | None = None, lease_ms: int = 60_000, retention: tuple[int, int] | None = None, metrics: Callable[[str, int], None] | None = None):
        """retention: seconds after which completed trees, and failed ones, are swept while the engine runs (0: never). metrics: gets each counter's increments."""
        self.log, self.queue, self.slots, self.types, self.lease_ms, self.retention = log, queue, slots, types, lease_ms, retention
        self.handlers = {h.activity_type: h for h in handlers}
        missing = set(types or []) - set(self.handlers)
        if missing:
            raise ValueError(f"no handler for {sorted(missing)}")
        self.worker = f"{queue}-{uuid.uuid4().hex[:8]}"
        self.metrics = Counters(metrics)
        self.counters: Counter = self.metrics.total
        self.query = None
        self._stopping, self._busy = threading.Event(), threading.Lock()
        self._beat_at = self._sweep_at = float("-inf")

    @property
    def spark(self) -> SparkSession:
        return self.log.spark

    # --- client ---------------------------------------------------------------------------

    def enqueue(self, requests: list[Request], now: datetime | None = None) -> list[str]:
        """Ids of new activities, or of those that already hold a key."""
        now = now or utc_now()
        rows = []
        for r in requests:
            o = r.checked(False).options
            rows.append((str(uuid.uuid4()), self.queue, r.activity_type, json.dumps(r.payload), o.get("priority"), o.get("max_retries"), o.get("timeout_seconds"), o.get("delay_seconds"), o.get("max_retry_delay_seconds"), [json.dumps(m) for m in o.get("metadata", [])], o.get("key"), o.get("behaviour", "return_existing")))
        df = self.spark.createDataFrame(rows, "id string, queue_name string, activity_type string, payload string, priority int, max_retries int, timeout_seconds long, delay_seconds long, max_retry_delay_seconds long, metadata array<string>, idempotency_key string, behaviour string")
        df = df.withColumn("metadata", S.merged_metadata("metadata"))
        with self.log.exclusive():
            return self._enqueue(df, rows, now)

    def _enqueue(self, df: DataFrame, rows: list[tuple], now: datetime) -> list[str]:
        names = {r[0]: r[0] for r in rows}
        fresh = df.filter("idempotency_key IS NULL")
        if any(r[10] is not None for r in rows):
            claims = df.filter("idempotency_key IS NOT NULL").withColumn("created_at", at(now))
            done = self._pinned(T.resolve_keys(claims, self.log.latest("keys"), self.log.latest("activities")))
            for row in done.collect():
                if row["activity_id"] is None:
                    raise ValueError(f"{row['action']}: {row['idempotency_key']}")
                names[row["id"]] = row["activity_id"]
            fresh = fresh.unionByName(df.join(done.filter("activity_id = id").select("id"), "id", "left_semi").select(df.columns))
        self._new(fresh, now)
        return [names[r[0]] for r in rows]

    def _new(self, requests: DataFrame, now: datetime) -> None:
        self.log.append(**self._rows_of_new(requests, now))

    def _rows_of_new(self, requests: DataFrame, now: datetime) -> dict[str, DataFrame]:
        """Rows of activities, events and keys of new activities."""
        more = requests.select("id", *[c for c in ("metadata", "idempotency_key") if c in requests.columns])
        new = T.new_activities(requests.drop("metadata", "idempotency_key"), at(now)).join(more, "id")
        events = self._events(T.enqueue(new), now)
        keys = new.filter("idempotency_key IS NOT NULL").select("queue_name", "idempotency_key", F.col("id").alias("activity_id"))
        return {"events": events, "keys": keys, "activities": new}

    def signal(self, activity_id: str, name: str, payload, now: datetime) -> bool:
        """Delivered, or not as there is no such activity."""
        s = self.spark.createDataFrame([(str(uuid.uuid4()), activity_id, name, json.dumps(payload))], "signal_id string, id string, name string, payload string")
        with self.log.exclusive():
            return self._signal(s, now)

    def _signal(self, s: DataFrame, now: datetime) -> bool:
        acts = self.log.latest("activities")
        done = self._pinned(T.signal(acts, s))
        if not done.first()["delivered"]:
            return False
        results = done.select(F.col("signal_id").alias("activity_id"), F.lit("Ok").alias("state"), "data", at(now).alias("created_at"), F.col("id").alias("owner_activity_id"), "step")
        events = done.select(F.col("id").alias("activity_id"), F.lit(self.queue).alias("queue_name"), "event_type", F.to_json(F.struct("signal_id", "woke")).alias("detail"), at(now).alias("created_at"))
        self.log.append(results=results, events=events, activities=self._moved(acts, T.wake(acts, done.select("id"))))
        return True

    def signal_by_key(self, activity_type: str, key: str, name: str, payload, now: datetime) -> bool:
        if not (activity_type and key and name):
            raise ValueError("type, key and name are needed")
        found = self.log.latest("keys").filter((F.col("queue_name") == self.queue) & (F.col("idempotency_key") == f"{key}-{activity_type}")).first()
        return found is not None and self.signal(found["activity_id"], name, payload, now)

    def extend_lease(self, activity_id: str, seconds: int, now: datetime | None = None) -> bool:
        """A lease that ends so many seconds from now, for an activity in process."""
        now = now or utc_now()
        with self.log.exclusive():
            acts = self.log.latest("activities")
            done = self._pinned(T.extend_lease(acts, self.spark.createDataFrame([(activity_id, seconds)], "id string, by_seconds long"), at(now)))
            if done.isEmpty():
                return False
            self.log.append(events=self._events(done, now), activities=acts.drop("lease_deadline_ms").join(done.select("id", "lease_deadline_ms"), "id"))
        return True

    def result(self, activity_id: str) -> tuple[str, str] | None:
        row = self.log.latest("results").filter(F.col("activity_id") == activity_id).first()
        return (row["state"], row["data"]) if row else None

    def wait_for_result(self, activity_id: str, timeout: float = 60, every: float = 0.5) -> tuple[str, str]:
        """The result as soon as there is one."""
        until = time.monotonic() + timeout
        while (found := self.result(activity_id)) is None:
            if time.monotonic() > until:
                raise TimeoutError(f"no result of {activity_id}")
            time.sleep(every)
        return found

    # --- one tick ---------------------------------------------------------------------------

    def _moved(self, acts: DataFrame, change: DataFrame) -> DataFrame:
        """Next rows: what change names is new, the worker and lease go unless it claims."""
        new = [c for c in change.columns if c in acts.columns and c != "id"]
        keep = [c for c in acts.columns if c not in new and c not in ("current_worker_id", "lease_deadline_ms")]
        return acts.select(*keep).join(change.select("id", *new), "id")

    def _pinned(self, df: DataFrame) -> DataFrame:
        """A bounded batch as plain rows: a cached one would be computed anew when the log grows."""
        return self.spark.createDataFrame(df.collect(), df.schema)

    def tick(self, now: datetime) -> int:
        """Activities that were claimed."""
        with self.log.exclusive():
            claimed = self._claim(now)
            n = claimed.count()
            # at most ``slots`` rows with their memos, read before another writer has its turn
            rows = self._pinned(self._inputs(claimed.select("id"))) if n else None
        if n:
            self._run(rows.repartition(n), now)
        self.counters["claimed"] += n
        return n

    def _claim(self, now: datetime) -> DataFrame:
        acts = self.log.latest("activities").filter(F.col("queue_name") == self.queue)
        reaped = self._pinned(T.reap(acts, at(now)))
        if not reaped.isEmpty():
            ended = reaped.filter("wakes IS NOT NULL").select(F.col("wakes").alias("parent_activity_id"))
            dead = self._ended(reaped.filter("state IS NOT NULL").withColumn("data", T.failure(F.lit("lease expired"), F.lit("dead_letter"), at(now))), now)
            moved = self._moved(acts, reaped).unionByName(self._moved(acts, T.wake_parents(acts, ended)), allowMissingColumns=True)
            self.log.append(results=dead, events=self._events(reaped, now), activities=moved)
            acts = self.log.latest("activities").filter(F.col("queue_name") == self.queue)
        claimed = self._pinned(T.claim(acts, self.queue, self.slots, self.worker, at(now), self.lease_ms, self.types))
        if not claimed.isEmpty():
            new = ["id", "status", "current_worker_id", "started_at", "lease_deadline_ms", "attempt"]
            self.log.append(events=self._events(claimed.withColumn("worker_id", F.col("current_worker_id")), now), activities=acts.drop(*new[1:]).join(claimed.select(new), "id"))
        return claimed

    def _ended(self, rows: DataFrame, now: datetime) -> DataFrame:
        """Results of activities that ended."""
        return rows.select(F.col("id").alias("activity_id"), "state", "data", at(now).alias("created_at"), F.col("id").alias("owner_activity_id"))

    def _events(self, rows: DataFrame, now: datetime) -> DataFrame:
        return rows.withColumn("activity_id", F.col("id")).withColumn("queue_name", F.lit(self.queue)).withColumn("created_at", at(now))

    def _inputs(self, ids: DataFrame) -> DataFrame:
        """Activities with their memos and their children's results."""
        acts, results = self.log.latest("activities"), self.log.latest("results")
        mine = acts.join(ids, "id", "left_semi")
        memo = results.filter("step IS NOT NULL").join(ids.withColumnRenamed("id", "owner_activity_id"), "owner_activity_id", "left_semi").groupBy(F.col("owner_activity_id").alias("id")).agg(F.collect_list(F.struct("step", "state", "data")).alias("memo"))
        own = results.filter("step IS NULL").select(F.col("activity_id").alias("child"), "state", "data")
        kids = acts.select(F.col("parent_activity_id").alias("id"), F.col("id").alias("child")).join(ids, "id", "left_semi")
        # activities that children's keys stand for
        named = memo.select("id", F.explode("memo").alias("m")).filter(F.col("m.step").startswith(ALIAS) & (F.col("m.state") == "Ok")).select("id", F.get_json_object(F.concat(F.lit('{"id":'), "m.data", F.lit("}")), "$.id").alias("child"))
        below = kids.unionByName(named).distinct().join(own, "child").groupBy("id").agg(F.collect_list(F.struct("child", "state", "data")).alias("below"))
        return mine.join(memo, "id", "left").join(below, "id", "left")

    def _run(self, rows: DataFrame, now: datetime) -> None:
        handlers, worker = self.handlers, self.worker

        def run(batches):
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    row = {k: (None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else v) for k, v in row.items()}
                    row["retry_count"], row["depth"], row["timeout_seconds"] = (int(row[k] or 0) for k in ("retry_count", "depth", "timeout_seconds"))
                    memo = {m["step"]: (m["state"], m["data"]) for m in (row["memo"] if row["memo"] is not None else [])}
                    below = {m["child"]: (m["state"], m["data"]) for m in (row["below"] if row["below"] is not None else [])}
                    done = attempt(handlers, row, memo, below, now)
                    done["worker_id"], done["attempt"] = worker, int(row["attempt"])
                    done["memo"] = [dict(zip(("step", "state", "data"), m, strict=True)) for m in done["memo"]]
                    out.append(done)
                yield pd.DataFrame(out, columns=["id", "worker_id", "attempt", "outcome", "data", "error", "wake_at", "kind", "step", "memo", "spawns"])

        # written once: a second read must not run handlers again
        path = f"{self.log.path}/_outcomes/{uuid.uuid4().hex}"
        rows.mapInPandas(run, OUTCOME).write.parquet(path)
        done = self.spark.read.schema(OUTCOME).parquet(path)
        with self.log.exclusive():
            dead = self._settle(done, now)
        self._delete(path)
        for row in dead:
            if row["activity_type"] in self.handlers:
                self.handlers[row["activity_type"]].on_dead_letter(json.loads(row["payload"] or "null"), row["last_error"])

    def _settle(self, done: DataFrame, now: datetime) -> list:
        """One batch of all that follows from handlers' outcomes; returns what died."""
        every, scratch = self.log.latest("activities"), []

        def kept(df: DataFrame) -> DataFrame:
            """Written once beside the log, however many rows: a second read is of the same rows."""
            scratch.append(f"{self.log.path}/_outcomes/{uuid.uuid4().hex}")
            df.write.parquet(scratch[-1])
            return self.spark.read.schema(df.schema).parquet(scratch[-1])

        held = self._pinned(every.filter("status = 'processing'").join(done.select("id"), "id", "left_semi"))
        # what isn't held any more changes nothing, its memos and children included
        counted = T.counted(held, done.select("id", "worker_id", "attempt", "outcome", "error"))
        mine = done.join(T.fenced(held, done.select("id", "worker_id", "attempt")).select("id"), "id", "left_semi")
        spawned = self._spawned(mine)
        own = spawned.filter(F.col("idempotency_key").isNotNull() & ~F.col("idempotency_key").startswith("rq:step:"))
        schema = "id string, caller string, parent_activity_id string, action string, target string"
        if own.isEmpty():  # as a rule; an empty relation leaves nothing of what follows in the plans
            keyed, mine = self.spark.createDataFrame([], schema), mine.withColumn("refused", F.lit(None).cast("boolean"))
        else:
            claims = own.withColumn("created_at", at(now) + F.make_dt_interval(secs=F.col("place") / 1_000_000))
            found = T.resolve_keys(claims, self.log.latest("keys"), every).select("id", "action", F.col("activity_id").alias("target"))
            keyed = kept(own.select("id", "caller", "parent_activity_id").join(found, "id"))
            refused = keyed.filter("target IS NULL").select(F.col("caller").alias("id")).distinct().withColumn("refused", F.lit(True))
            # a run whose key was refused is done again, at once, and told so
            mine = kept(mine.join(refused, "id", "left").withColumns({"outcome": F.when(F.col("refused"), "yield").otherwise(F.col("outcome")), "kind": F.when(F.col("refused"), "await").otherwise(F.col("kind")), "step": F.when(F.col("refused"), F.lit(None)).otherwise(F.col("step"))}))
            spawned = self._spawned(mine)
        waits = mine.filter("kind = 'await'").select("id", F.col("step").alias("child"), F.coalesce("refused", F.lit(False)).alias("refused")).join(keyed.select(F.col("id").alias("child"), "target"), "child", "left").select("id", "refused", F.coalesce("target", "child").alias("child"), F.col("target").isNotNull().alias("named"))
        # the batch's own rows, their parents, the children they wait for or start: the rest is local
        around = held.select(F.col("parent_activity_id").alias("id")).unionByName(waits.select(F.col("child").alias("id"))).unionByName(spawned.select("id")).unionByName(keyed.select(F.col("target").alias("id")))
        acts = held.unionByName(kept(every.join(around.filter("id IS NOT NULL").distinct(), "id", "left_semi").join(held.select("id"), "id", "left_anti")))
        commands = mine.filter("outcome <> 'yield'").select("id", "worker_id", "attempt", "outcome", "error", "data")
        # at most a row for each of the activities that were claimed
        good, bad = self._pinned(T.ack_success(held, commands, at(now))), self._pinned(T.ack_failure(held, commands, at(now)))
        # the end of a child that another parent started wakes that parent; whoever else waits for it looks again
        look = waits.filter("named").select("id", S.plus_seconds(at(now), F.lit(LOOK_SECONDS)).alias("look"))
        parked = T.park(held, mine.filter("outcome = 'yield'").join(look, "id", "left").select("id", "worker_id", "attempt", F.coalesce("wake_at", "look").alias("wake_at"), "kind", "step"))
        over = bad.filter("state IS NOT NULL")
        # a parent is woken by the end of any child, and doesn't sleep for a child that has ended
        parents = good.select("parent_activity_id").unionByName(over.select(F.col("wakes").alias("parent_activity_id")))
        ended = acts.filter(F.col("status").isin(S.TERMINAL)).select("id").unionByName(good.select("id")).unionByName(over.select("id"))
        awaits = waits.select(F.col("id").alias("parent"), F.col("child").alias("id")).join(ended, "id", "left_semi").select(F.col("parent").alias("id")).unionByName(waits.filter("refused").select("id"))
        ready = awaits.unionByName(parents.select(F.col("parent_activity_id").alias("id"))).filter("id IS NOT NULL").distinct().withColumn("ready", F.lit(True))
        now_or_later = {"status": F.when(F.col("ready"), "pending").otherwise(F.col("status")), "scheduled_at": F.when(F.col("ready"), F.lit(None)).otherwise(F.col("scheduled_at"))}
        parked = self._pinned(parked.join(ready, "id", "left").withColumns(now_or_later))
        steps = mine.select("id", F.explode("memo").alias("m")).select("id", "m.*")
        json_text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
        aliases = keyed.select(F.col("caller").alias("id"), F.concat(F.lit(ALIAS), "id").alias("step"), F.when(F.col("target").isNull(), "Err").otherwise("Ok").alias("state"), json_text(F.coalesce("target", "action")).alias("data"))
        memo = steps.unionByName(aliases).select(S.checkpoint_id("id", "step").alias("activity_id"), "state", "data", at(now).alias("created_at"), F.col("id").alias("owner_activity_id"), "step")
        stored = memo.select(F.col("activity_id").alias("id"), F.lit("ResultStored").alias("event_type"), F.to_json(F.struct(F.col("owner_activity_id").alias("owner"), "step")).alias("detail"))
        made = spawned.join(keyed.filter("target IS NULL OR target <> id").select("id"), "id", "left_anti").join(acts.select("id"), "id", "left_anti").dropDuplicates(["id"])
        known = acts.select("id", "parent_activity_id").unionByName(made.select("id", "parent_activity_id"))
        links = T.spawn_links(keyed.filter("target <> id AND parent_activity_id IS NOT NULL").select(F.col("target").alias("child_id"), F.col("caller").alias("parent_id")), known)
        events = stored.unionByName(links.select(F.col("child_id").alias("id"), "event_type", F.to_json(F.struct("parent_id")).alias("detail")))
        for rows in (good.select("id", "event_type"), bad.select("id", "event_type"), parked.select("id", "event_type", "detail")):
            events = events.unionByName(rows, allowMissingColumns=True)
        moved = self._moved(acts, good)
        for change in (bad, parked, T.wake_parents(acts, parents)):
            moved = moved.unionByName(self._moved(acts, change), allowMissingColumns=True)
        new = self._rows_of_new(made.drop("caller", "place", "behaviour"), now)
        events, seen = observed(self._events(events, now).unionByName(new["events"], allowMissingColumns=True), counted)
        try:
            self.log.append(
                results=memo.unionByName(self._ended(good, now), allowMissingColumns=True).unionByName(self._ended(over, now), allowMissingColumns=True),
                keys=new["keys"],
                activities=new["activities"].unionByName(moved, allowMissingColumns=True),
                events=events,
            )
            self.metrics.add(seen.get)
            return over.filter("status = 'dead_letter'").select("id", "last_error").join(held.drop("last_error"), "id").select("activity_type", "payload", "last_error").collect()
        finally:
            for path in scratch:
                self._delete(path)

    def _spawned(self, done: DataFrame) -> DataFrame:
        """Children that handlers started, in their order."""
        s = done.select(F.col("id").alias("caller"), F.posexplode("spawns").alias("place", "s")).select("caller", "place", "s.*")
        names = {"key": "idempotency_key", "parent": "parent_activity_id", "root": "root_activity_id"}
        given = ["id", "caller", "place", "behaviour", "activity_type", "payload", "priority", "max_retries", "timeout_seconds", "delay_seconds", "max_retry_delay_seconds", "metadata"]
        return s.withColumn("metadata", S.merged_metadata("metadata")).select(*given, F.lit(self.queue).alias("queue_name"), *[F.col(k).alias(v) for k, v in names.items()], (F.col("depth") - 1).alias("parent_depth"))

    def _delete(self, path: str) -> None:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def sweep(self, now: datetime, completed_ttl: int = 0, failed_ttl: int = 0, batch: int = 100) -> int:
        """Expired trees, oldest first."""
        with self.log.exclusive():
            acts = self.log.latest("activities")
            roots = self._pinned(T.expired_roots(acts, self.queue, at(now), completed_ttl, failed_ttl, batch))
            n = roots.count()
            if n:
                tables = {t: self.log.latest(t) for t in ("results", "events", "keys")} | {"activities": acts}
                self.log.erase(T.sweep(tables, roots))
                self.metrics.add({"activity_trees_swept": n})
        return n

    # --- life -------------------------------------------------------------------------------

    def _beat(self) -> None:
        """One trigger: a beat of the pool, a tick, and sweeps when they are due, batch by batch until one is short."""
        with self._busy:
            if self._stopping.is_set():
                return
            now = utc_now()
            if time.monotonic() - self._beat_at > BEAT_SECONDS:
                self._beat_at = time.monotonic()
                self._pool(self.slots, now)
            self.tick(now)
            self.log.fold(FOLD_COMMITS)
            if self.retention and time.monotonic() - self._sweep_at > SWEEP_SECONDS:
                self._sweep_at = time.monotonic()
                while self.sweep(utc_now(), *self.retention) >= 100 and not self._stopping.is_set():
                    pass

    def _pool(self, workers: int | None, now: datetime) -> None:
        schema = "pool_id string, queue_name string, max_workers int, activity_types array<string>"
        with self.log.exclusive():
            self.log.append(pools=self.spark.createDataFrame([(self.worker, self.queue, workers, self.types)], schema).withColumn("last_seen_at", at(now)))

    def start(self, checkpoint: str, every: str = "1 second") -> None:
        """Tick on a trigger until stop()."""
        self._stopping.clear()
        beat = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        self.query = beat.writeStream.foreachBatch(lambda _df, _n: self._beat()).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

    def stop(self, grace: float = 30) -> bool:
        """No new claims; the batch in flight has ``grace`` seconds to end, then it is cut off and its leases run out. True if it ended."""
        if self.query is None:
            return True
        self._stopping.set()
        drained = self._busy.acquire(timeout=max(0.0, grace))
        self.query.stop()
        self.query = None
        if drained:
            self._busy.release()
            self._pool(None, utc_now())
        return drained
