"""Durable timers over a table of commands, whole histories at once; streaming/timers.py keeps them as they come.

A command is (activity_id, timer, op, kind, due_ms, attempt, at_ms, seq). An activity has one timer of each name. ``set`` arms it and takes an earlier
one away; ``extend`` moves it only while it is armed; ``cancel`` takes it away. Commands count in order of (at_ms, seq). A timer fires at its due
time, or at once if that is over, unless a command comes first; one of the same millisecond does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalar as S

COMMAND = "activity_id string, timer string, op string, kind string, due_ms long, attempt int, at_ms long, seq long"
#: Why an activity in a state that is compared with its schedule waits.
KINDS = {"scheduled": "delay", "retrying": "retry", "waiting": "sleep"}
WAKE, LEASE = "wake", "lease"


def commands(rows: DataFrame) -> DataFrame:
    """Commands from states of activities as the log has them, batch or stream: id, status, scheduled_at, lease_deadline_ms, seq and, where known, attempt and at_ms.

    Each new state sets or cancels both timers of its activity: the one it is woken by, and the one its lease ends by. A lease that is
    extended is a state of its own, so its timer is set anew and the old one never fires.
    """
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("status")]
    due = F.when(kind.isNotNull(), S.epoch_ms(F.col("scheduled_at")))
    lease = F.when(F.col("status") == "processing", F.col("lease_deadline_ms"))
    own = [(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in (("attempt", "int"), ("at_ms", "long"), ("seq", "long"))]

    def one(timer, kind, due):
        return F.struct(F.lit(timer).alias("timer"), F.when(due.isNotNull(), "set").otherwise("cancel").alias("op"), F.when(due.isNotNull(), kind).alias("kind"), due.alias("due_ms"))

    return rows.select(F.col("id").alias("activity_id"), F.inline(F.array(one(WAKE, kind, due), one(LEASE, F.lit("lease"), lease))), *own)


def fired(commands: DataFrame, as_of_ms) -> DataFrame:
    """Timers that fire until a time: activity_id, timer, kind, due_ms, attempt, fired_ms, seq (of the command that armed it last).

    A set or cancel begins a run, which extensions prolong; in a run the first deadline that passes before the next command fires, and what comes
    after it extends nothing. One shuffle, by timer. Commands without a due time arm nothing, those without a time are left out.
    """
    key, order = ["activity_id", "timer"], ["at_ms", "seq"]
    w = Window.partitionBy(*key).orderBy(*order)
    c = commands.filter("at_ms IS NOT NULL").withColumns({"next_ms": F.lead("at_ms").over(w), "run": F.sum((F.col("op") != "extend").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    fires = F.greatest("due_ms", "at_ms")
    gap = F.coalesce((F.col("op") != "cancel") & F.col("due_ms").isNotNull() & (F.col("next_ms").isNull() | (fires < F.col("next_ms"))), F.lit(False))
    run = Window.partitionBy(*key, "run").orderBy(*order)
    c = c.withColumn("gap", gap).withColumns({"first_op": F.first("op").over(run), "gaps": F.sum(F.col("gap").cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0))})
    found = c.filter("gap AND gaps = 1 AND first_op = 'set'").withColumn("fired_ms", fires)
    return found.filter(F.col("fired_ms") <= as_of_ms).select(*key, "kind", "due_ms", "attempt", "fired_ms", "seq")
