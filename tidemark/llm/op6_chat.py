"""Operator 6: chat formatting. Tool calls are linked with results, ordered, validated and serialised."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Neighbouring turns of a conversation that are ordered in one task, and links that a task holds.
TURNS, LINKS = 4096, 500_000
NODE_SCHEMA = "conv_id long, turn long, place long, level int"
CALLS = "struct<tool_calls:array<struct<id:string,name:string,arguments:string,depends_on:array<string>>>>"
RESULT = "struct<tool_call_id:string,content:string>"
OUT_SCHEMA = "conv_id long, turn long, place long, level int, role string, message string, linked boolean, problems string"
_KINDS = {"string": str, "boolean": bool, "array": list, "object": dict, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no white space and shortest numbers; non-finite numbers are an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def schema_errors(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with value under a JSON schema: type, enum, required, properties, additionalProperties, items, minimum, maximum."""
    kind = schema.get("type")
    if kind in ("integer", "number"):
        good = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or float(value).is_integer())
    else:
        good = kind is None or isinstance(value, _KINDS.get(kind, object))
    if not good:
        return [f"{at}: not of type {kind}"]
    out = [f"{at}: not in enum"] if "enum" in schema and value not in schema["enum"] else []
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: below minimum"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", math.inf) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += schema_errors(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and isinstance(schema.get("items"), dict):
        for k, x in enumerate(value):
            out += schema_errors(x, schema["items"], f"{at}[{k}]")
    return out


def _message(role: str | None, text: str | None, call: bool, result: bool, schemas: dict) -> tuple[str, list[str]]:
    problems = []
    body = {"role": role, "content": text}
    if call:
        raw = json.loads(text)
        calls = []
        for x in raw["tool_calls"]:
            given = x.get("arguments")
            try:
                given = json.loads(given) if isinstance(given, str) else given
            except ValueError:
                problems.append(f"{x.get('id')}: arguments are not JSON")
            name = x.get("name")
            if name not in schemas and schemas:
                problems.append(f"{x.get('id')}: no schema for {name}")
            elif name in schemas:
                problems += [f"{x.get('id')}: {e}" for e in schema_errors(given, schemas[name])]
            calls.append({"id": x.get("id"), "name": name, "arguments": given})
        body = {"role": role, "content": raw.get("content"), "tool_calls": calls}
    elif result:
        raw = json.loads(text)
        body = {"role": role, "tool_call_id": raw["tool_call_id"], "content": raw.get("content")}
    return canonical(body), problems


def _is(text: str | None, field: str, kind) -> bool:
    if not text or field not in text:
        return False
    try:
        raw = json.loads(text)
        canonical(raw)
    except ValueError:
        return False
    if not isinstance(raw, dict) or not isinstance(raw.get(field), kind):
        return False
    return kind is not list or all(isinstance(x, dict) for x in raw[field])


def _settled(conv, u, v, place, level):
    """Messages that wait for settled ones only, wave by wave: their numbers among the links' ends, with place and level.

    conv, u, v: the links of several conversations, from turn u to turn v. place, level: those of u where
    it was settled before, else level is below 0.
    """
    key = np.stack([np.concatenate([conv, conv]), np.concatenate([u, v])], 1)
    nodes, ends = np.unique(key, axis=0, return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    n = len(nodes)
    done, at, rank = np.zeros(n, bool), nodes[:, 1].copy(), np.zeros(n, np.int64)
    before = level >= 0
    done[a[before]], at[a[before]], rank[a[before]] = True, place[before], level[before]
    was = done.copy()
    by_u, by_v = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    out_first, in_first = np.searchsorted(a[by_u], np.arange(n + 1)), np.searchsorted(b[by_v], np.arange(n + 1))
    waits = np.bincount(b[~done[a]], minlength=n)
    wave = np.flatnonzero((waits == 0) & (np.diff(in_first) > 0) & ~done)
    while len(wave):
        count = in_first[wave + 1] - in_first[wave]
        first = a[by_v[C.ranges(in_first[wave], count)]]
        head = np.cumsum(count) - count
        most = np.maximum.reduceat(at[first], head)
        last = np.maximum.reduceat(np.where(at[first] == np.repeat(most, count), rank[first] + 1, 0), head)
        # a message that stands behind all it waits for stays
        moved = most >= nodes[wave, 1]
        at[wave[moved]], rank[wave[moved]] = most[moved], last[moved]
        done[wave] = True
        after, times = np.unique(b[by_u[C.ranges(out_first[wave], out_first[wave + 1] - out_first[wave])]], return_counts=True)
        waits[after] -= times
        wave = after[(waits[after] == 0) & ~done[after]]
    new = np.flatnonzero(done & ~was)
    return nodes[new, 0], nodes[new, 1], at[new], rank[new]


def _ordered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, place, level) of every message of the links (conv_id, u, v) that can be ordered, and the conversations with a cycle.

    Each round settles, within TURNS neighbouring turns at a time, all messages whose links come from settled ones;
    it ends when a round settles none, and what is left is on a cycle or behind one.
    """
    spark = edges.sparkSession
    ends = edges.select("conv_id", F.col("v").alias("turn"))
    nodes = C.written(edges.select("conv_id", F.col("u").alias("turn")).distinct().join(ends.distinct(), ["conv_id", "turn"], "left_anti").select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("level")))
    nb = max(C.shuffle_partitions(spark), -(-edges.count() // LINKS))

    def settle(batches):
        parts = [[b.column(c).fill_null(-1).to_numpy() for c in range(5)] for b in batches]
        conv, u, v, place, level = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield C.batch_of(NODE_SCHEMA, list(_settled(conv, u, v, place, level)))

    still, done = edges, nodes
    while True:
        known = still.join(done.select("conv_id", F.col("turn").alias("u"), "place", "level"), ["conv_id", "u"], "left")
        task = F.pmod(F.xxhash64("conv_id", F.floor(F.col("v") / TURNS)), F.lit(nb)).alias("task")
        found = known.select("conv_id", "u", "v", "place", "level", task).groupBy("task").applyInArrow(C.per_group(lambda batches: settle(b.select(["conv_id", "u", "v", "place", "level"]) for b in batches)), NODE_SCHEMA)
        found = C.written(found)
        if found.isEmpty():
            break
        done = C.written(done.unionByName(found))
        still = C.written(still.join(done.select("conv_id", F.col("turn").alias("v")), ["conv_id", "v"], "left_anti"))
        if still.isEmpty():
            break
    return done, C.written(still.select("conv_id").distinct())


def format_chat(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One canonical JSON message per turn, with its place in its conversation.

    turns has conv_id, turn, role, text. An assistant's text that is an object with a list
    ``tool_calls`` (id, name, arguments, depends_on) makes calls; a tool's text that is an object
    with ``tool_call_id`` is a result. Calls and results are hash-joined by conversation and
    identifier. A result comes after its call, and a call after the results it depends on: order
    by (place, level, turn), where place is the latest turn that a message waits for and level its
    rank behind it. Chains may have any length. Arguments are validated against the schema of their
    name. Keys of the JSON are sorted. Messages stay one row each: no conversation's texts are
    gathered in one task, nor more of its links than those of TURNS turns.

    problems lists invalid arguments, calls without results, results without calls, identifiers
    used twice and cyclic dependencies (the messages of such a conversation stay by turn); it is null if there are none.
    Null role or text become JSON nulls. Repeated rows come back repeated; rows with a null
    conv_id or turn are formatted and never linked. Broken JSON is plain text. Other columns play no part.
    Returns conv_id, turn, place, level, role, message, linked, problems.
    """
    schemas = schemas or {}
    spark = turns.sparkSession
    C.small_batches(spark)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    if_call = (F.col("role") == "assistant") & F.col("text").contains('"tool_calls"')
    if_result = (F.col("role") == "tool") & F.col("text").contains('"tool_call_id"')
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    calls = rows.filter(if_call & known).select("conv_id", "turn", F.explode(F.from_json("text", CALLS).getField("tool_calls")).alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("id"), F.col("c.depends_on").alias("needs")).filter("id IS NOT NULL")
    results = rows.filter(if_result & known).select("conv_id", "turn", F.from_json("text", RESULT).getField("tool_call_id").alias("id")).filter("id IS NOT NULL")
    notes = None
    if not (calls.isEmpty() and results.isEmpty()):
        calls, results = C.written(calls), C.written(results)
        key = ["conv_id", "id"]
        n_calls = calls.groupBy(*key).agg(F.count("*").alias("n_calls"), F.min("turn").alias("call_turn"))
        n_results = results.groupBy(*key).agg(F.count("*").alias("n_results"), F.max("turn").alias("result_turn"))
        known_ids = C.written(n_calls.join(n_results, key, "full"))
        problem = F.when(F.col("n_calls").isNull(), F.concat("id", F.lit(": no call"))).when(F.col("n_results").isNull(), F.concat("id", F.lit(": no result")))
        problem = problem.when((F.col("n_calls") > 1) | (F.col("n_results") > 1), F.concat("id", F.lit(": used twice")))
        uses = calls.select("conv_id", "turn", "id").unionByName(results)
        notes = uses.join(known_ids.withColumn("problem", problem), key).groupBy("conv_id", "turn")
        notes = notes.agg(F.count_if(F.col("n_calls").isNotNull() & F.col("n_results").isNotNull()).alias("links"), F.array_sort(F.collect_set("problem")).alias("notes"))
        # before -> after, by turn
        edges = results.join(n_calls, key).select("conv_id", F.col("call_turn").alias("u"), F.col("turn").alias("v"))
        waits = calls.select("conv_id", "turn", F.explode("needs").alias("id")).join(n_results, key).select("conv_id", F.col("result_turn").alias("u"), F.col("turn").alias("v"))
        edges = C.written(edges.unionByName(waits).filter("u <> v").distinct())
        place, cyclic = _ordered(edges)
        touched = edges.select("conv_id", F.col("v").alias("turn")).unionByName(edges.select("conv_id", F.col("u").alias("turn"))).distinct()
        cyclic = touched.join(cyclic, "conv_id", "left_semi").select("conv_id", "turn", F.lit(None).cast("long").alias("place"), F.lit(None).cast("int").alias("level"), F.lit(True).alias("cycle"))
        place = place.join(cyclic.select("conv_id").distinct(), "conv_id", "left_anti").withColumn("cycle", F.lit(False)).unionByName(cyclic)
        notes = notes.join(place.select("conv_id", "turn", F.struct("place", "level").alias("p"), "cycle"), ["conv_id", "turn"], "full")
        rows = rows.join(notes, ["conv_id", "turn"], "left")
        rows = rows.select("conv_id", "turn", F.coalesce("p.place", "turn").alias("place"), F.coalesce("p.level", F.lit(0)).alias("level"), "role", "text", (F.coalesce("links", F.lit(0)) > 0).alias("linked"), F.concat_ws("\n", F.coalesce("notes", F.array().cast("array<string>")), F.when(F.col("cycle"), F.lit("cyclic dependencies"))).alias("notes"))
    else:
        rows = rows.select("conv_id", "turn", F.col("turn").alias("place"), F.lit(0).alias("level"), "role", "text", F.lit(False).alias("linked"), F.lit("").alias("notes"))

    def serialise(batches):
        for b in batches:
            x = b.to_pydict()
            messages, problems = [], []
            for role, text, notes in zip(x["role"], x["text"], x["notes"], strict=True):
                call = role == "assistant" and _is(text, "tool_calls", list)
                result = role == "tool" and _is(text, "tool_call_id", str)
                message, found = _message(role, text, call, result, schemas)
                messages.append(message)
                found = [*filter(None, notes.split("\n")), *found]
                problems.append("; ".join(found) if found else None)
            yield C.batch_of(OUT_SCHEMA, [b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), messages, b.column(6), problems])

    return rows.mapInArrow(C.tidied(serialise), OUT_SCHEMA)


#: The tool of the lifted calls, and its arguments' schema.
SCHEMAS = {"reply": {"type": "object", "required": ["chars", "turn"], "additionalProperties": False, "properties": {"chars": {"type": "integer", "minimum": 0, "maximum": 300}, "turn": {"type": "integer"}}}}


def lifted(conversations: DataFrame) -> DataFrame:
    """Conversations with tool calls and results, by fixed rules, as the tables hold none.

    An assistant's turn t calls ``reply`` with the length of its text and t, under identifier
    "c<t>"; from turn 3 on the call depends on "c<t-2>". A user's turn t from 2 on is the
    result of "c<t-1>". Conversations with an odd conv_id are logged in reverse (turn -t), so that
    their order has to be found.
    """
    t, role = F.col("turn"), F.col("role")
    name = lambda n: F.concat(F.lit("c"), n.cast("string"))
    call = F.struct(name(t).alias("id"), F.lit("reply").alias("name"), F.to_json(F.struct(F.length("text").alias("chars"), t.alias("turn"))).alias("arguments"), F.when(t >= 3, F.array(name(t - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    result = (role == "user") & (t >= 2)
    text = F.when(role == "assistant", F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")))).when(result, F.to_json(F.struct(name(t - 1).alias("tool_call_id"), F.col("text").alias("content")))).otherwise(F.col("text"))
    return conversations.select("conv_id", F.when(F.col("conv_id") % 2 == 1, -t).otherwise(t).alias("turn"), F.when(result, "tool").otherwise(role).alias("role"), text.alias("text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(lifted(C.table(spark, sf_dir, "conversations")), SCHEMAS)


#: A message waits for the turn before it alone, so places follow the turns.
ORACLE_SQL = """
WITH RECURSIVE lifted AS (
  SELECT a.conv_id, a.turn AS t, CASE WHEN a.conv_id % 2 = 1 THEN -a.turn ELSE a.turn END AS turn, a.text,
    CASE WHEN a.role = 'user' AND a.turn >= 2 THEN 'tool' ELSE a.role END AS role, p.role AS before, n.role AS after
  FROM conversations a LEFT JOIN conversations p ON p.conv_id = a.conv_id AND p.turn = a.turn - 1
    LEFT JOIN conversations n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1
), links AS (
  SELECT *, coalesce(role = 'tool' AND before = 'assistant' OR role = 'assistant' AND t >= 3 AND before = 'user', false) AS waits,
    coalesce(role = 'tool' AND before = 'assistant' OR role = 'assistant' AND t >= 1 AND after = 'user', false) AS linked
  FROM lifted
), placed AS (
  SELECT conv_id, t, turn AS place, 0 AS level FROM links WHERE NOT waits
  UNION ALL
  SELECT l.conv_id, l.t, greatest(p.place, l.turn), CASE WHEN p.place >= l.turn THEN p.level + 1 ELSE 0 END
  FROM placed p JOIN links l ON l.conv_id = p.conv_id AND l.t = p.t + 1 AND l.waits
)
SELECT l.conv_id, l.turn, p.place, p.level, l.role, l.linked,
  CASE l.role
    WHEN 'assistant' THEN '{"content":' || to_json(text)::VARCHAR || ',"role":"assistant","tool_calls":[{"arguments":{"chars":' || length(text) || ',"turn":' || t || '},"id":"c' || t || '","name":"reply"}]}'
    WHEN 'tool' THEN '{"content":' || to_json(text)::VARCHAR || ',"role":"tool","tool_call_id":"c' || (t - 1) || '"}'
    ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(l.role)::VARCHAR || '}' END AS message,
  nullif(concat_ws('; ', CASE WHEN l.role = 'assistant' AND NOT linked THEN 'c' || t || ': no result' END, CASE WHEN l.role = 'tool' AND NOT linked THEN 'c' || (t - 1) || ': no call' END,
    CASE WHEN l.role = 'assistant' AND length(text) > 300 THEN 'c' || t || ': $.chars: above maximum' END), '') AS problems
FROM links l JOIN placed p USING (conv_id, t)
"""
