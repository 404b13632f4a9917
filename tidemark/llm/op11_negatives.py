"""Operator 11: hard-negative mining by distributed radix selection over integer scores."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.op7_topk import _products

#: Bytes of vectors in a block; anchors in a block, and bytes of them, which bound what is broadcast.
BLOCK_BYTES, ANCHORS, ANCHOR_BYTES = 4_000_000, 1024, 8_000_000
#: Bits of a digit: a window's histogram has 256 buckets.
DIGIT = 8
BLOCK_SCHEMA = "width int, n int, ids binary, labels binary, vectors binary"
POSITIVE_SCHEMA = "anchor int, vec_id long, score long"
COUNT_SCHEMA = "window int, bucket int, n long, need long"
FOUND_SCHEMA = "window int, anchor_id long, positive_id long, positive_rank int, negative_id long, positive_score long, negative_score long"
OUT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"]


def _blocks(batches):
    """Vectors of one width in rows of about BLOCK_BYTES."""
    held: dict = {}

    def out(width):
        ids, labels, vectors = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
        return C.batch_of(BLOCK_SCHEMA, [[width], [len(ids)], [ids.tobytes()], [labels.tobytes()], [vectors.tobytes()]])

    for b in batches:
        ids, labels, widths = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (0, 1, 3))
        flat, ends = b.column(2).flatten().to_numpy(), np.cumsum(widths)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            some = flat[(ends[rows] - width)[:, None] + np.arange(width)]
            step = max(1, BLOCK_BYTES // (8 * width))
            for lo in range(0, len(rows), step):
                cut = slice(lo, lo + step)
                held.setdefault(width, []).append((ids[rows[cut]], labels[rows[cut]], some[cut]))
                if sum(len(x[0]) for x in held[width]) * width * 8 >= BLOCK_BYTES:
                    yield out(width)
            if sum(v[0].nbytes for x in held.values() for _, _, *v in x) > 4 * BLOCK_BYTES:
                for w in list(held):
                    yield out(w)
    for w in list(held):
        yield out(w)


class Anchors:
    """A block of anchors, and their windows once they are known."""

    def __init__(self, rows: list):
        self.ids, self.labels = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
        self.widths = np.array([len(r[2]) for r in rows])
        self.vectors = {w: np.array([r[2] for r in rows if len(r[2]) == w], np.int64) for w in set(self.widths.tolist())}

    def scores(self, batches):
        """(anchor, its scores with a block, the block's ids, True where labels are the same)."""
        for row in C.rows_of(batches):
            width, ids, labels = row["width"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            if width not in self.vectors:
                continue
            block, who = np.frombuffer(row["vectors"], np.int64).reshape(-1, width), np.flatnonzero(self.widths == width)
            for lo in range(0, len(who), 128):
                got = _products(self.vectors[width][lo : lo + 128], block)
                for a, line in zip(who[lo : lo + 128].tolist(), got, strict=True):
                    yield a, line, ids, labels == self.labels[a]


def _cut(best: tuple, score: np.ndarray, ids: np.ndarray, k: int) -> tuple:
    """The k highest scores, of equal ones the smaller ids, of those so far and new ones."""
    if len(score) > k:
        few = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= few)
        score, ids = score[at], ids[at]
    score, ids = np.concatenate([best[0], score]), np.concatenate([best[1], ids])
    order = np.lexsort((ids, ~score))[:k]
    return score[order], ids[order]


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _positives(blocks: DataFrame, anchors: Anchors, k: int) -> list:
    """The first k rows of each anchor's own label, without the anchor: at most k rows of a task, k of all."""
    sent = blocks.sparkSession.sparkContext.broadcast(anchors)

    def best(batches):
        held: dict = {}
        for a, score, ids, same in sent.value.scores(batches):
            good = same & (ids != sent.value.ids[a])
            held[a] = _cut(held.get(a, _NONE), score[good], ids[good], k)
        for a, (score, ids) in held.items():
            yield C.batch_of(POSITIVE_SCHEMA, [np.full(len(ids), a), ids, score])

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    found = blocks.mapInArrow(C.tidied(best), POSITIVE_SCHEMA).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return sorted(found.select("anchor", "rank", "vec_id", "score").collect())


class Windows:
    """The score windows of pairs of an anchor and a positive, and how far each one's kth score is known.

    A score is a distance below the window's top; ``prefix`` holds the leading digits of the kth distance, ``need`` how many of
    the k have them, and a settled window takes all rows of at most ``last``.
    """

    def __init__(self, positives: list, k: int, low: int, high: int):
        rows = [(*p, -(-low * p[3] // high)) for p in positives]
        rows = [r for r in rows if r[4] <= r[3]]
        self.anchor, self.rank, self.positive, self.top, low_score = (np.array([r[c] for r in rows], np.int64) for c in range(5))
        self.width = self.top - low_score
        self.need, self.prefix = np.full(len(rows), k), np.zeros(len(rows), np.int64)
        self.last = self.width.copy()
        self.settled = np.zeros(len(rows), bool)
        self.levels = max(1, -(-int(self.width.max(initial=0)).bit_length() // DIGIT))
        self.of = {a: np.flatnonzero(self.anchor == a).tolist() for a in set(self.anchor.tolist())}

    def learn(self, level: int, found: list) -> None:
        """found: of each open window the bucket that holds the kth row, the rows before it, and those to its end; none where all rows are fewer."""
        shift, kth = DIGIT * (self.levels - 1 - level), {r[0]: r[1:] for r in found}
        for w in np.flatnonzero(~self.settled).tolist():
            if w not in kth:  # fewer than k rows: all of the window
                self.settled[w] = True
                continue
            bucket, before, upto = kth[w]
            self.prefix[w] = self.prefix[w] << DIGIT | bucket
            self.last[w] = min(int(self.width[w]), (int(self.prefix[w]) << shift) + (1 << shift) - 1)
            self.settled[w] = upto == self.need[w] or shift == 0
            self.need[w] -= before


def _counts(blocks: DataFrame, anchors: Anchors, windows: Windows, level: int) -> DataFrame:
    """Rows of each open window by their digit of this level, among those that share its prefix; summed in each task, then over all."""
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, windows))
    shift, buckets = DIGIT * (windows.levels - 1 - level), 1 << DIGIT

    def count(batches):
        anchors, windows = sent.value
        held: dict = {}
        for a, score, _, same in anchors.scores(batches):
            mine = [w for w in windows.of.get(a, []) if not windows.settled[w]]
            if not mine:
                continue
            score = score[~same]
            for w in mine:
                d = windows.top[w] - score[(score <= windows.top[w]) & (score >= windows.top[w] - windows.width[w])]
                d = d[d >> shift >> DIGIT == windows.prefix[w]]
                if len(d):
                    held[w] = held.get(w, 0) + np.bincount((d >> shift) & (buckets - 1), minlength=buckets)
        for w, n in held.items():
            full = np.flatnonzero(n)
            yield C.batch_of(COUNT_SCHEMA, [np.full(len(full), w), full, n[full], np.full(len(full), windows.need[w])])

    summed = blocks.mapInArrow(C.tidied(count), COUNT_SCHEMA).groupBy("window", "bucket").agg(F.sum("n").alias("n"), F.max("need").alias("need"))
    upto = F.sum("n").over(Window.partitionBy("window").orderBy("bucket"))
    return summed.withColumn("upto", upto).filter("upto >= need AND upto - n < need").select("window", "bucket", (F.col("upto") - F.col("n")).alias("before"), "upto")


def _gathered(blocks: DataFrame, anchors: Anchors, windows: Windows, k: int) -> DataFrame:
    """Qualifying rows alone: those up to each window's kth score; of equal scores a task sends no more than k, the smaller ids."""
    sent = blocks.sparkSession.sparkContext.broadcast((anchors, windows))

    def gather(batches):
        anchors, windows = sent.value
        held: dict = {}
        for a, score, ids, same in anchors.scores(batches):
            if a not in windows.of:
                continue
            score, ids = score[~same], ids[~same]
            for w in windows.of[a]:
                good = np.flatnonzero((score <= windows.top[w]) & (score >= windows.top[w] - windows.last[w]))
                if len(good):
                    held[w] = _cut(held.get(w, _NONE), score[good], ids[good], k)
        for w, (score, ids) in held.items():
            n = len(ids)
            yield C.batch_of(FOUND_SCHEMA, [np.full(n, w), np.full(n, anchors.ids[windows.anchor[w]]), np.full(n, windows.positive[w]), np.full(n, windows.rank[w]), ids, np.full(n, windows.top[w]), score])

    order = Window.partitionBy("window").orderBy(F.desc("negative_score"), "negative_id")
    found = blocks.mapInArrow(C.tidied(gather), FOUND_SCHEMA)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*OUT)


def hard_negatives(vectors: DataFrame, k: int = 5, positives: int = 5, low: int = 80, high: int = 100, every: int = 100, scale: int = 256, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """The k hardest negatives of each anchor and positive: rows of other labels whose score lies in a window below the positive's.

    Components become floor(scale * x); a score is the inner product with the anchor, exact in 64 bits. Anchors are rows
    whose id is divisible by ``every``; an anchor's positives are its first rows of the same label. A negative's score
    must be at most the positive's, and at least low/high of it. Higher scores come first, ties by smaller id.

    Radix selection: vectors lie in blocks, written once; anchors are sent to them in blocks of bounded size. Each window's scores are
    counted by their leading digit, the bucket of the kth is looked up in the sums, and the next pass counts only
    what has that digit, and so on; then only rows up to the kth score are gathered. Windows with at most k rows, or whose kth ends
    a bucket, end early. Each task counts before the shuffle, so equal vectors, however many, are one count.

    Rows with a null id, label or vector, an empty vector, or a null or non-finite component take no part; lengths other than
    the anchor's have no score with it. A repeated id is a candidate as often as it occurs, never its own anchor's, and
    one anchor: the least of its (label, vector). Fewer rows than asked give fewer; a window without rows, an anchor without positives
    and an empty table give none. A component or score beyond 64 bits is an error. Other columns play no part.
    Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank.
    """
    spark = vectors.sparkSession
    C.small_batches(spark)
    x = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(column).alias("v"))
    x = x.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    x = x.filter(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    x = x.select("id", "label", F.transform("v", lambda e: F.floor(e.cast("double") * scale)).alias("v"), F.size("v").alias("w"))
    blocks = C.written(x.mapInArrow(C.tidied(_blocks), BLOCK_SCHEMA))
    asked = C.written(x.filter(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v")).alias("least")).select("id", "least.label", "least.v"))
    n, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = -(-n // max(1, min(ANCHORS, ANCHOR_BYTES // (8 * (wide or 1)))))

    def found():
        for b in range(parts):
            rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == b).collect()
            anchors = Anchors([tuple(r) for r in rows])
            windows = Windows(_positives(blocks, anchors, positives) if rows else [], k, low, high)
            for level in range(windows.levels):
                if windows.settled.all():
                    break
                windows.learn(level, _counts(blocks, anchors, windows, level).collect())
            if len(windows.top):
                yield _gathered(blocks, anchors, windows, k)
        yield spark.createDataFrame([], FOUND_SCHEMA + ", rank int").select(*OUT)

    out = C.written_all(found())
    C.dropped(blocks, asked)
    return out


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = C.table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.select("vec_id", "embedding", label.alias("label")))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank
  FROM scored WHERE same QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
