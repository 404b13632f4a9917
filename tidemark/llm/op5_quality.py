"""Operator 5: quality classifier. Weak labels by expectation-maximisation train a hashed linear scorer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import logistic

#: Most rows that the scorer is fitted on, drawn by a hash of the text.
SAMPLE = 6000
#: Buckets of hashed features.
DIMS = 512
#: Bytes added to a length, so that a few odd bytes don't sway very short texts.
SHORT = 100
#: Votes: 0 abstain, 1 bad, 2 good.
LABELLERS = ["symbols", "shouting", "exclaiming", "piped", "repeating", "lines_repeat", "odd_letters", "clean_form", "prose"]
VOTE_SCHEMA = "code int, n long"
SCORE_SCHEMA = "doc_id long, code int, posterior double, score double"
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in " \t\r\v\f" else 5 if _c == "\n" else 6 if _c in ".,;:" else 7 if _c in "'\"()" else 8 if _c in "!?" else 9 if _c == "|" else 10 if _c in "#$%&*" else 11 if _c in "<>{}[]=/\\_^~+`@-" else 12 if _b >= 0x80 else 0
_HASHED = (C.mix(np.arange(16**3, dtype=np.uint64)) % np.uint64(DIMS - 1)).astype(np.int64)
#: The bucket of words that repeat one just before.
_AGAIN = DIMS - 1


class Measures:
    """Counts over each document of a batch."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.n = n = len(off) - 1
        self.off, self.kind = off, _KIND[buf]
        bounds = C.word_bounds(buf, off)
        self.starts, self.ends, self.first = bounds
        words = C.bytes_hashes(buf, self.starts, self.ends)
        per = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[off]).astype(np.float64)
        self.kinds = np.stack([per(self.kind == k) for k in range(13)], 1) if len(buf) else np.zeros((n, 13))
        self.words = np.diff(self.first).astype(np.float64)
        again = np.zeros(len(words), bool)
        place = np.arange(len(words)) - np.repeat(self.first[:-1], np.diff(self.first))
        for back in (1, 2, 3):
            again[back:] |= (words[back:] == words[:-back]) & (place[back:] >= back)
        self.again_at = again
        self.again = np.diff(np.concatenate([[0], np.cumsum(again)])[self.first]).astype(np.float64)
        # repeated lines
        line_cut = np.zeros(len(buf) + 1, bool)
        line_cut[off] = True
        line_cut[1:] |= np.append(buf == 10, False)[:-1] if len(buf) else False
        at = np.flatnonzero(line_cut)
        at = at[at < len(buf)]
        to = np.append(at[1:], len(buf)) if len(at) else at
        key = C.bytes_hashes(buf, at, to)
        doc = np.searchsorted(off, at, side="right") - 1
        order = np.lexsort((key, doc))
        twice = ~C.group_starts(doc[order], key[order]) & (to - at > 20)[order] if len(at) else np.zeros(0, bool)
        self.lines = np.bincount(doc, minlength=n).astype(np.float64)
        self.same_lines = np.bincount(doc[order][twice], minlength=n).astype(np.float64)

    def votes(self) -> np.ndarray:
        """A code in base 3, a digit for each labeller."""
        k, words = self.kinds, np.maximum(self.words, 1)
        size = np.maximum(k.sum(1), 1)
        letters = np.maximum(k[:, 1] + k[:, 2] + k[:, 12] / 2, 1)
        symbols, caps, shouts, pipes = (k[:, 10] + k[:, 0]) / size, k[:, 2] / letters, k[:, 8] / words, k[:, 9] / words
        again, lines = self.again / words, self.same_lines / np.maximum(self.lines, 1)
        odd, per_word, stops = (k[:, 0] + k[:, 8:12].sum(1)) / size, (size - k[:, 4] - k[:, 5]) / words, k[:, 6] / words
        calm = (symbols < 0.01) & (caps < 0.3) & (shouts < 0.05) & (pipes < 0.05) & (again < 0.1) & (lines < 0.2)
        bad = [symbols > 0.05, caps > 0.5, shouts > 0.25, pipes > 0.15, again > 0.25, lines > 0.3, odd > 0.08, None, (words >= 20) & ((stops < 0.01) | (per_word > 18) | (per_word < 2))]
        good = [None] * 7 + [calm, calm & (words >= 3) & (stops >= 0.02) & (per_word < 14) & (per_word > 2.5)]
        code = np.zeros(self.n, np.int64)
        for j, (b, g) in enumerate(zip(bad, good, strict=True)):
            vote = np.zeros(self.n, np.int64)
            if g is not None:
                vote[g] = 2
            if b is not None:
                vote[b] = 1
            code += vote * 3**j
        return np.where(self.words == 0, 0, code)

    def triples(self) -> np.ndarray:
        k = self.kind
        return _HASHED[k[:-2] * 256 + k[1:-1] * 16 + k[2:]] if len(k) > 2 else np.zeros(0, np.int64)

    def hashed(self) -> np.ndarray:
        """Shares of hashed triples of character kinds, for each document."""
        t = self.triples()
        doc = np.repeat(np.arange(self.n), np.diff(self.off))[: len(t)]
        out = np.bincount(doc * DIMS + t, minlength=self.n * DIMS).reshape(self.n, DIMS).astype(np.float64)
        out[:, _AGAIN] = self.again * 5
        return 30 * out / (np.diff(self.off) + SHORT)[:, None]

    def linear(self, weights: np.ndarray) -> np.ndarray:
        """logistic.score of hashed(), without the matrix."""
        t = self.triples()
        sums = np.concatenate([[0.0], np.cumsum(weights[t]), [0.0, 0.0]])
        sums[len(t) :] = sums[len(t)]
        total = sums[self.off[1:]] - sums[self.off[:-1]] if len(t) else np.zeros(self.n)
        total = total + weights[_AGAIN] * self.again * 5
        return 1 / (1 + np.exp(-np.clip(30 * total / (np.diff(self.off) + SHORT) + weights[-1], -30, 30)))


def label_model(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(good) for each pattern of votes, by expectation-maximisation.

    Each labeller has, for either class, its own chances to abstain, to vote bad and to vote
    good; votes are independent given the class. The start is the balance of the votes.
    """
    votes = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    balance = (votes == 2).sum(1) - 2.0 * (votes == 1).sum(1)
    p = 1 / (1 + np.exp(-2 * balance))
    for _ in range(rounds):
        old = p
        chance = np.empty((2, len(LABELLERS), 3))
        share = []
        for c, q in ((0, 1 - p), (1, p)):
            weight = counts * q
            share.append(weight.sum() + 1)
            for v in range(3):
                chance[c, :, v] = ((votes == v) * weight[:, None]).sum(0) + 1
            chance[c] /= chance[c].sum(1, keepdims=True)
        logs = np.log(share)[:, None] + np.stack([np.log(chance[c][np.arange(len(LABELLERS)), votes]).sum(1) for c in (0, 1)])
        p = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        p = np.where(codes == 0, 0.5, p)  # no vote says nothing
        if np.abs(p - old).max() < 1e-6:
            break
    return p


def _fitted(texts: DataFrame, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Posterior by pattern of votes, and the scorer's weights. texts has the one column text."""
    C.small_batches(texts.sparkSession)

    def vote(batches):
        total = {}
        for b in C.slices(batches, 0):
            codes, n = np.unique(Measures(*C.column_bytes(b.column(0))).votes(), return_counts=True)
            for c, k in zip(codes.tolist(), n.tolist(), strict=True):
                total[c] = total.get(c, 0) + k
        yield C.batch_of(VOTE_SCHEMA, [list(total), list(total.values())])

    patterns = texts.mapInArrow(C.tidied(vote), VOTE_SCHEMA).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    codes, counts = np.array([r["code"] for r in patterns], np.int64), np.array([r["n"] for r in patterns], np.float64)
    posterior, weights = np.full(3 ** len(LABELLERS), 0.5), np.zeros(DIMS + 1)
    if not len(codes):
        return posterior, weights
    posterior[codes] = label_model(codes, counts)
    share = min(1.0, sample / counts.sum())
    drawn = texts.filter(C.drawn("text", share)) if share < 1 else texts
    schema = "code int, x binary"

    def measured(batches):
        for b in C.slices(batches, 0):
            m = Measures(*C.column_bytes(b.column(0)))
            yield C.batch_of(schema, [m.votes(), [x.tobytes() for x in m.hashed().astype(np.float32)]])

    # chance may draw more than asked for: distinct texts, of least hash up to the bound
    rows = drawn.dropDuplicates(["text"]).orderBy(F.xxhash64("text"), "text").limit(2 * sample).mapInArrow(C.tidied(measured), schema).toPandas()
    rows = rows[rows["code"] > 0]
    if len(rows):
        x = np.stack([np.frombuffer(r, np.float32) for r in rows["x"]])
        weights = logistic.fit(x, posterior[rows["code"].to_numpy()], ridge=0.05)
    return posterior, weights


def quality_scores(docs: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Weak votes, their posterior and a trained score (P(good)) for every whole text.

    Nine labellers vote on each document. Their patterns are counted over all documents (at most
    3**9 rows reach the driver); expectation-maximisation gives each labeller's accuracies and
    each pattern's posterior. A linear scorer over hashed triples of character kinds is fitted
    to the posteriors of about ``sample`` distinct texts, drawn by a hash (twice as many
    at most), and scores all.

    A null or empty text, or one of white space, has no vote, posterior 0.5 and nearly the scorer's
    bias as its score. Rows come back as often as they come; other columns play no part. An empty
    table gives no rows. Returns doc_id, code, posterior, score.
    """
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text"))
    posterior, weights = _fitted(texts.select("text"), sample)

    def scored(batches):
        for b in C.slices(batches, 1):
            m = Measures(*C.column_bytes(b.column(1)))
            code = m.votes()
            yield C.batch_of(SCORE_SCHEMA, [b.column(0), code, posterior[code], m.linear(weights)])

    return texts.mapInArrow(C.tidied(scored), SCORE_SCHEMA)


def quality_filter(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE, text: str = "text") -> DataFrame:
    """The rows of docs whose text scores ``least`` or more, with all their columns. See quality_scores."""
    _, weights = _fitted(docs.select(docs[text].alias("text")), sample)
    at = docs.columns.index(text)

    def kept(batches):
        for b in C.slices(batches, at):
            yield b.filter(pa.array(Measures(*C.column_bytes(b.column(at))).linear(weights) >= least))

    return docs.mapInArrow(C.tidied(kept), docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_scores(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("code").alias("votes"), "posterior", "score", (F.col("score") >= 0.5).alias("kept"))
