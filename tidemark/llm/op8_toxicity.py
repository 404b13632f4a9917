"""Operator 8: toxicity, by Levenshtein automata over a lexicon trie and context windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import logistic
from tidemark.llm.automaton import NEAR, STEM, WORD, Automaton

#: Most labelled rows that the model is fitted on, drawn by a hash of doc_id.
SAMPLE = 20_000
#: Chance, over all words, that a word gets into the lexicon that tells nothing.
CHANCE = 0.05
#: Bytes on each side of a match that tell its context.
WINDOW = 60
FEATURES = 10
#: Weights before any label is seen: matches count, less so when quoted or misspelled, more so when someone is addressed.
PRIOR = np.array([3.0, 3.0, 1.0, 0.5, 0.5, 0.2, 1.0, 0.0, 0.0, 0.0, -3.0])
SCORE_SCHEMA = "doc_id long, score double, matches int, quoted int"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(0x80, 0x100)]] = True
#: Words that address someone.
ADDRESS = [b"you", b"your", b"youre", b"u", b"du", b"ihr", b"tu", b"vous", b"usted"]
#: Words that report speech.
REPORT = [b"said", b"says", b"called", b"quote", b"quoted", b"wrote", b"word", b"term", b"sagte", b"dijo", b"dit"]


def _lower(buf: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1 in UTF-8 become small."""
    out = C.lowered(buf)
    capital = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


def features(buf: np.ndarray, off: np.ndarray, lexicon: Automaton, address: Automaton, report: Automaton) -> np.ndarray:
    """For each document: matches by kind, outside and inside quotation, addressed ones, and its length."""
    n_docs = len(off) - 1
    out = np.zeros((n_docs, FEATURES))
    if not len(buf):
        return out
    low = _lower(buf)
    is_word, cut = _WORD[buf], np.zeros(len(buf) + 1, bool)
    cut[off] = True
    here, before = np.append(is_word, False), np.append(False, is_word)
    starts, ends = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
    kind = lexicon.match(low, starts, ends)
    hit = np.flatnonzero(kind)
    doc_of = lambda at: np.searchsorted(off, at, side="right") - 1
    if len(hit):
        at, to = starts[hit], ends[hit]
        doc = doc_of(at)
        lo, hi = np.maximum(at - WINDOW, off[doc]), np.minimum(to + WINDOW, off[doc + 1])
        # quotation marks: ASCII ", and the second and third bytes of typographic ones
        mark = low == 0x22
        mark[1:] |= (low[1:] == 0xAB) & (buf[:-1] == 0xC2) | (low[1:] == 0xBB) & (buf[:-1] == 0xC2)
        mark[2:] |= (buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) & (buf[2:] >= 0x9C) & (buf[2:] <= 0x9F)
        marks = np.concatenate([[0], np.cumsum(mark)])
        near = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
        # only words in some window are looked up
        window = np.zeros(len(starts) + 1, np.int64)
        np.add.at(window, near[0], 1)
        np.add.at(window, near[1], -1)
        some = np.flatnonzero(np.cumsum(window[:-1]) > 0)
        said = np.zeros((2, len(starts) + 1), np.int64)
        for k, words in enumerate((address, report)):
            said[k, some + 1] = words.match(low, starts[some], ends[some]) == WORD
        said = np.cumsum(said, axis=1)
        addressed, reported = (said[k, near[1]] - said[k, near[0]] > 0 for k in (0, 1))
        enclosed = (marks[at] - marks[lo] > 0) & (marks[hi] - marks[to] > 0)
        quoted = enclosed | (reported & ~addressed)
        for k, what in enumerate((WORD, STEM, NEAR)):
            for q in (0, 1):
                out[:, k + 3 * q] += np.bincount(doc[(kind[hit] == what) & (quoted == bool(q))], minlength=n_docs)
        out[:, 6] += np.bincount(doc[addressed & ~quoted], minlength=n_docs)
        out[:, 7] = np.bincount(doc[quoted], minlength=n_docs)
    count = np.bincount(doc_of(starts), minlength=n_docs)
    out[:, 8], out[:, 9] = count / 100, out[:, 2] * 100 / np.maximum(count, 1)
    return np.log1p(out)


def _lexicon(sample: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Words and stems that labelled rows mark as toxic, from distinct texts.

    A term is kept if four in five of its texts are toxic, and if that many would come by chance with a probability below
    CHANCE over all terms (by the bound of Chernoff), whatever the number of such terms.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]{3,40})"), 1))
    texts = sample.dropDuplicates(["text"])
    n, toxic = texts.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < n:
        return [], []
    share = toxic / n
    seen = texts.select("toxic", F.explode(words).alias("w"))
    counts = C.written(seen.groupBy("w").agg(F.sum("toxic").alias("n1"), F.sum(1 - F.col("toxic")).alias("n0")).filter("n1 >= 1"))
    least = float(np.log(max(1, counts.count()) / CHANCE))
    both = F.col("n1") + F.col("n0")
    evidence = F.col("n1") * F.log(F.col("n1") / (both * share)) + F.when(F.col("n0") > 0, F.col("n0") * F.log(F.col("n0") / (both * (1 - share)))).otherwise(0.0)
    found = counts.filter("n1 >= 4 * n0").filter(evidence > least).orderBy(F.desc("n1"), "w").select("w").collect()
    # a stem is the start of several such words, and of hardly any other
    starts = counts.select("w", "n1", "n0", F.explode(F.sequence(F.lit(4), F.greatest(F.lit(4), F.least(F.lit(8), F.length("w") - 1)))).alias("k")).filter("k < length(w)")
    starts = starts.groupBy(F.expr("substring(w, 1, k)").alias("s")).agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"), F.count("*").alias("forms"))
    starts = C.written(starts.filter("forms >= 4 AND n1 >= 8 * n0").filter(evidence > least + float(np.log(5))))
    clean = seen.filter("toxic = 0").select(F.explode(F.expr("transform(sequence(4, 8), k -> substring(w, 1, k))")).alias("s")).groupBy("s").agg(F.count("*").alias("clean"))
    starts_left = starts.join(clean, "s", "left").filter("n1 >= 8 * coalesce(clean, 0)").select("s", "n1").collect()
    stems: list[str] = []
    for r in sorted(starts_left, key=lambda r: (len(r["s"]), -r["n1"], r["s"])):
        if not any(r["s"].startswith(s) for s in stems):
            stems.append(r["s"])
    terms = [r["w"] for r in found if not any(r["w"].startswith(s) for s in stems)]
    C.dropped(counts, starts)
    return [w.encode() for w in terms], [s.encode() for s in stems]


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A toxicity score from 0 to 1 for every whole text.

    labels has doc_id and toxic (0 or 1). Terms that mark toxic rows make a lexicon of words and
    stems, held as a trie; its intersection with a Levenshtein automaton for one edit finds
    them misspelled as well. A window around each match tells quotation (marks on both sides, or
    reported speech) from abuse (someone is addressed). A logistic regression weighs the counts;
    its prior stands in where labels say nothing. About ``sample`` labelled ids are used (twice as
    many at most), drawn by a hash of doc_id, one row each; all rows are scored.

    A null or empty text is scored like one without matches. Rows come back as often as they
    come; a null doc_id stays null. Repeated labels of a doc_id count once, by the highest. No
    labels, or labels of one kind, leave the prior. Other columns play no part. An empty table
    gives no rows. Returns doc_id, score, matches, quoted.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    use = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    have = use.count()
    if have > sample:
        # chance may draw more than asked for: those of least hash up to the bound
        use = use.filter(C.drawn("doc_id", sample / have)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)
    taken = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # one row of each id, so that the rows have the ids' bound
    taken = C.written(taken.join(F.broadcast(use), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    words, stems = _lexicon(taken)
    lexicon, address, report = Automaton(words, stems), Automaton(ADDRESS, [], 99), Automaton(REPORT, [], 99)
    tools = spark.sparkContext.broadcast((lexicon, address, report))
    schema = "toxic int, " + ", ".join(f"x{k} double" for k in range(FEATURES))

    def seen(batches):
        for b in C.slices(batches, 1):
            x = features(*C.column_bytes(b.column(1)), *tools.value)
            yield C.batch_of(schema, [b.column(0), *x.T])

    rows = taken.select("toxic", "text").mapInArrow(C.tidied(seen), schema).toPandas().to_numpy()
    C.dropped(taken)
    weights = PRIOR
    if len(rows) and 0 < rows[:, 0].sum() < len(rows):
        weights = logistic.fit(rows[:, 1:], rows[:, 0], PRIOR)

    def scored(batches):
        for b in C.slices(batches, 1):
            x = features(*C.column_bytes(b.column(1)), *tools.value)
            counts = np.expm1(x).round().astype(np.int32)
            yield C.batch_of(SCORE_SCHEMA, [b.column(0), logistic.score(x, weights), counts[:, :6].sum(1), counts[:, 7]])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(C.tidied(scored), SCORE_SCHEMA)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = C.table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~fold)
    found = toxicity(C.table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", fold.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
