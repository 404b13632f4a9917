"""Operator 7: exact top-k search by a threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Vectors in a block of lists; queries in a block, and bytes of them, which bound what is broadcast.
BLOCK, QUERY_BLOCK, QUERY_BYTES = 4096, 4096, 8_000_000
LIST_SCHEMA = "width int, n int, ids binary, vectors binary, places binary"
PART_SCHEMA = "query_id long, vec_id long, score long"
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows of a with rows of b as 64-bit integers; an error if one doesn't fit."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    top = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if top < 1 << 53:  # exact in doubles
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if top < 1 << 63:
        return a @ b.T
    return (a.astype(object) @ b.T.astype(object)).astype(np.int64)


def _limits(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a vector can score at most if no component is above high or below low."""
    top = int(np.abs(queries).max(initial=0)) * max(int(np.abs(high).max(initial=0)), int(np.abs(low).max(initial=0))) * max(1, queries.shape[1])
    kind = np.int64 if top < 1 << 63 else object
    q = queries.astype(kind)
    total = np.where(queries > 0, q * high.astype(kind), q * low.astype(kind)).sum(1)
    return np.minimum(np.maximum(total, _LEAST), _MOST).astype(np.int64)


def threshold_top_k(queries: np.ndarray, own: np.ndarray, bound: np.ndarray, ids: np.ndarray, vectors: np.ndarray, places: np.ndarray, k: int, deepest: int | None = None):
    """The k best (score, then smaller id) of each query among vectors, by Fagin's threshold algorithm.

    places has for each dimension the vectors in order of value. Sorted access goes down the lists side by side, from depth 1
    on: from the high end where the component of a query is positive, from the low end where
    it is negative, in lists that some unfinished query needs. Vectors met are scored whole. A query ends when its limit, the score of
    a vector that has the values at that depth in every dimension, is below its kth score or its
    ``bound``, a score that k vectors elsewhere are known to reach (equal ones may still win by id, so
    those go on). own: the id that each query may not return. deepest: stop there, with what is found.

    Returns ids and scores, k of each query, those that are missing with the least score; and how many vectors were scored.
    """
    n, d = vectors.shape
    ranked = np.take_along_axis(vectors, places, axis=0)
    score, who = np.full((len(queries), k), _LEAST), np.full((len(queries), k), _MOST)
    seen, active, before, depth = np.zeros(n, bool), np.arange(len(queries)), 0, 1

    def meet(fresh):
        for lo in range(0, len(fresh), 1024):
            some = fresh[lo : lo + 1024]
            got = _products(queries[active], vectors[some])
            got[ids[some][None, :] == own[active][:, None]] = _LEAST
            both = np.concatenate([score[active], got], 1)
            names = np.concatenate([who[active], np.broadcast_to(ids[some], got.shape)], 1)
            names = np.where(both == _LEAST, _MOST, names)
            best = np.lexsort((names, ~both), axis=1)[:, :k]
            score[active], who[active] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)

    while len(active):
        q = queries[active]
        up, down = (q > 0).any(0), (q < 0).any(0)
        met = np.zeros(n, bool)
        met[places[n - depth : n - before, up]] = True
        met[places[before:depth, down]] = True
        fresh = np.flatnonzero(met & ~seen)
        seen[fresh] = True
        meet(fresh)
        if depth == n:
            rest = np.flatnonzero(~seen)  # queries without any component walk no list
            seen[rest] = True
            meet(rest)
            break
        if deepest is not None and depth >= deepest:
            break
        limit = _limits(q, ranked[n - depth], ranked[depth - 1])
        active = active[limit >= np.maximum(score[active, k - 1], bound[active])]
        before, depth = depth, min(n, depth + max(1, depth // 2))
    return who, score, int(seen.sum())


def _lists(batches):
    """One row of a block's vectors: their ids, and their order by value in every dimension."""
    ids, rows = [], []
    for b in batches:
        ids.append(b.column(0).to_numpy())
        rows.append(b.column(1).flatten().to_numpy())
    ids = np.concatenate(ids)
    vectors = np.concatenate(rows).reshape(len(ids), -1)
    places = np.argsort(vectors, axis=0, kind="stable").astype(np.int32)
    yield C.batch_of(LIST_SCHEMA, [[vectors.shape[1]], [len(ids)], [ids.tobytes()], [np.ascontiguousarray(vectors).tobytes()], [places.tobytes()]])


def _found(lists: DataFrame, queries: list, bounds: dict, k: int, deepest: int | None) -> DataFrame:
    """The k best of each block for each of a block of queries."""
    asked: dict = {}
    for q, v in queries:
        asked.setdefault(len(v), []).append((q, v, bounds.get(q, _LEAST)))
    arrays = {w: (np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.int64), np.array([x[2] for x in some], np.int64)) for w, some in asked.items()}
    sent = lists.sparkSession.sparkContext.broadcast(arrays)

    def search(batches):
        for row in C.rows_of(batches):
            if row["width"] not in sent.value:
                continue
            q, vectors, bound = sent.value[row["width"]]
            shape = (row["n"], row["width"])
            ids, mine = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int64).reshape(shape)
            who, score, _ = threshold_top_k(vectors, q, bound, ids, mine, np.frombuffer(row["places"], np.int32).reshape(shape), k, deepest)
            good = (score > _LEAST) & (score >= bound[:, None])
            yield C.batch_of(PART_SCHEMA, [np.broadcast_to(q[:, None], who.shape)[good], who[good], score[good]])

    return lists.mapInArrow(C.tidied(search), PART_SCHEMA)


def _best(parts: DataFrame, k: int) -> DataFrame:
    """k rows a query: cut in each partition before the shuffle, and after it."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return parts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k highest inner products of each query with all other rows, exactly.

    Components become floor(scale * x). Queries are the rows whose id is divisible by
    ``every``; candidates are all rows but the query's own id. Candidates lie in blocks, each with
    a sorted list per dimension, written once. A block of queries is sent to all of them: first the heads of
    the lists give each query a score that k vectors reach; then every block walks its lists
    down to where nothing can beat that score or its own kth (see threshold_top_k).

    Ties go to the smaller id. A vector that is null or has a null or non-finite component, a
    null id, or a length other than the query's takes no part. A repeated id is a candidate as
    often as it occurs, and its queries count once, by the least of its vectors. Fewer than k
    candidates give fewer rows; no rows give none. Scores are exact in 64 bits; a component or
    score that doesn't fit is an error. Other columns play no part.
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    C.small_batches(spark)
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(column).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    x = x.filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    x = C.written(x.select("id", F.transform("v", lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.size("v").alias("w")))
    n, asked, wide = x.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max("w")).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-n // BLOCK)
    dealt = x.select("id", "v", "w", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).alias("b"))
    lists = C.written(dealt.groupBy("w", "b").applyInArrow(C.per_group(lambda batches: _lists(b.select(["id", "v"]) for b in batches)), LIST_SCHEMA))
    queries = x.filter(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v"))
    query_blocks = -(-asked // max(1, min(QUERY_BLOCK, QUERY_BYTES // (8 * wide))))

    def found():
        for b in range(query_blocks):
            some = [(r["id"], r["v"]) for r in queries.filter(F.pmod(F.xxhash64("id"), F.lit(query_blocks)) == b).collect()]
            if some:
                heads = _best(_found(lists, some, {}, k, k + 1), k).filter(F.col("rank") == k)
                reached = {r["query_id"]: r["score"] for r in heads.collect()}
                yield _best(_found(lists, some, reached, k, None), k)

    return C.written_all(found()).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(C.table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
