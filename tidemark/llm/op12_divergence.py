"""Operator 12: audit of how sources diverge from their language, by an upper-bound search for terms and postings for pairs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Bytes of text that are counted at a time, and buckets of counts and probabilities to an octave.
SLICE_BYTES, STEPS = 8_000_000, 4
COUNT_SCHEMA = "lang string, source string, term string, n long, docs long"
#: A-Z, a-z and every byte of a character beyond ASCII belong to terms.
_TERM = np.zeros(256, bool)
_TERM[65:91] = _TERM[97:123] = _TERM[128:] = True


def _counted(batches):
    """Occurrences and documents of each term of each (lang, source), slice by slice."""
    for b in C.slices(batches, 2, SLICE_BYTES):
        buf, offsets = C.column_bytes(b.column(2))
        inside, edge = np.zeros(len(buf) + 1, bool), np.zeros(len(buf) + 1, bool)
        inside[:-1] = _TERM[buf]
        edge[offsets] = True
        before = np.concatenate([[False], inside[:-1]])
        starts, ends = np.flatnonzero(inside & (~before | edge)), np.flatnonzero(before & (~inside | edge))
        if not len(starts):
            continue
        words = C.strings(C.lowered(buf[inside[:-1]]), np.concatenate([[0], np.cumsum(ends - starts)]), pa.large_binary() if len(buf) >> 31 else pa.binary())
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        doc = np.searchsorted(offsets, starts, side="right") - 1
        own, times = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)  # terms of one document
        langs, sources = (b.column(c).dictionary_encode() for c in (0, 1))
        group = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        of_group = group[own // size] * size + own % size
        order = np.argsort(of_group, kind="stable")
        begin = np.flatnonzero(C.group_starts(of_group[order]))
        key = of_group[order][begin]
        g = key // size
        columns = [langs.dictionary.take(pa.array(g // len(sources.dictionary))), sources.dictionary.take(pa.array(g % len(sources.dictionary))), coded.dictionary.take(pa.array(key % size)).cast(pa.string())]
        yield C.batch_of(COUNT_SCHEMA, [*columns, np.add.reduceat(times[order], begin), np.diff(np.append(begin, len(order)))])


def _probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)), exact for any count of 64 bits."""
    top = F.lit(1_000_000_000).cast("decimal(10,0)") * (n + 2).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (total + 2 * kept).cast("decimal(20,0)"))


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); with p > q it grows with p and falls with q."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _octaves(x: Column) -> Column:
    return F.floor(F.log2(x.cast("double")) * STEPS).cast("int")


def entries(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: one row of each occurring (lang, source); one of each kept term that a group holds.

    groups: lang, source, total (occurrences of kept terms in the group), kept (terms of the lang), zero (probability of a term the group
    lacks). entries: lang, term, source, n, p (probability in the group), q (in the lang), zero, and buckets of n and q.
    """
    counts = docs.mapInArrow(C.tidied(_counted), COUNT_SCHEMA).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("postings"))
    kept = C.written(kept.filter(F.col("docs") >= least).drop("docs"))
    langs = kept.groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count("*").alias("kept"))
    single = kept.select("lang", "term", "all", F.inline("postings"))
    totals = single.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    zero = F.when(F.col("kept") > 0, _probability(F.lit(0), F.col("total"), F.col("kept")))
    groups = C.written(groups.withColumn("zero", zero))
    p, q = _probability(F.col("n"), F.col("total"), F.col("kept")), _probability(F.col("all"), F.col("lang_total"), F.col("kept"))
    found = single.join(groups, ["lang", "source"]).select("lang", "term", "source", "n", p.alias("p"), q.alias("q"), "zero")
    found = C.written(found.withColumns({"n_bucket": _octaves(F.col("n")), "q_bucket": _octaves(F.col("q"))}))
    C.dropped(kept)
    return groups, found


def best_terms(found: DataFrame, top: int, rounds: list | None = None) -> DataFrame:
    """The ``top`` most divergent terms of each group among those more likely there than in the lang, best first.

    A group's terms lie in buckets of like counts and like probabilities in the lang; the largest p and the smallest q of a bucket bound the
    divergence of all in it. Buckets are evaluated from the highest bound on, some at a time in all groups at once, and a group stops when the
    bounds of its unseen buckets are below its value of rank ``top``; an equal one may still win by name. rounds gets the terms evaluated in each round.
    """
    group, bucket = ["lang", "source"], ["n_bucket", "q_bucket"]
    bounds = found.groupBy(*group, *bucket).agg(F.max("p").alias("high"), F.min("q").alias("low"), F.count("*").alias("terms")).filter("high > low")
    bounds = bounds.withColumn("bound", _divergence(F.col("high"), F.col("low")))
    above = Window.partitionBy(*group).orderBy(F.desc("bound"), *bucket)
    bounds = C.written(bounds.withColumn("before", F.sum("terms").over(above) - F.col("terms")))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "term")
    best, seen, reach = None, 0, 4 * top
    while True:
        pending = bounds.filter(F.col("before") >= seen)
        if best is not None:
            kth = best.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
            pending = pending.join(kth, group, "left").filter("kth IS NULL OR bound >= kth")
        nearest = pending.agg(F.min("before")).first()[0]
        if nearest is None and best is not None:
            C.dropped(bounds)
            return best
        reach = max(reach, (nearest or 0) + 1)
        taken = pending.filter(F.col("before") < reach)
        if rounds is not None:
            rounds.append(taken.agg(F.sum("terms")).first()[0] or 0)
        value = found.join(taken.select(*group, *bucket), [*group, *bucket]).filter("p > q").select(*group, "term", _divergence(F.col("p"), F.col("q")).alias("value"))
        value = value if best is None else value.unionByName(best.drop("rank"))
        before, best = best, C.written(value.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
        if before is not None:
            C.dropped(before)
        seen, reach = reach, 8 * reach


def source_pairs(groups: DataFrame, found: DataFrame) -> DataFrame:
    """The divergence of each two sources of a lang, summed over all its kept terms, both ways: lang, source, item, value.

    The sum starts as if all terms were missing in both. A source's terms, as many as share a count at once, add what they change against each other
    source that lacks them; and where the postings of a term hold both, what that differs from the two changes is added.
    """
    a, b = (groups.select("lang", F.col("source").alias(x), F.col("zero").alias(f"{x}_zero"), "kept") for x in ("a", "b"))
    pairs = a.drop("kept").join(b, "lang").filter("a <> b")
    base = pairs.select("lang", "a", "b", F.when(F.col("kept") > 0, F.col("kept") * _divergence(F.col("a_zero"), F.col("b_zero"))).otherwise(0).alias("value"))
    like = found.groupBy("lang", F.col("source").alias("a"), F.col("zero").alias("a_zero"), "p").agg(F.count("*").alias("terms"))
    change = F.col("terms") * (_divergence(F.col("p"), F.col("b_zero")) - _divergence(F.col("a_zero"), F.col("b_zero")))
    one = like.join(b, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(change).alias("value"))
    lists = found.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "p", "zero"))).alias("all"))
    both = lists.select("lang", F.posexplode("all").alias("at", "x"), "all").select("lang", "x", F.explode(F.expr("slice(all, at + 2, size(all))")).alias("y"))
    px, zx, py, zy = (F.col(c) for c in ("x.p", "x.zero", "y.p", "y.zero"))
    extra = _divergence(px, py) - _divergence(px, zy) - _divergence(zx, py) + _divergence(zx, zy)
    both = both.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(F.sum(extra).alias("value"))
    turned = [x.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for x in (one, both)]
    rows = reduce(DataFrame.unionByName, [base, one, both, *turned])
    return rows.groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item")).agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """How far each source of a language is from the others, and by which terms from the language.

    Terms are runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. A lang keeps its terms of at least ``least``
    documents. A group's (or lang's) probability of a kept term is p = 1 + floor(10^9 (count + 2) / (occurrences + 2 terms)), and two
    probabilities diverge by floor((p - q)^2 / (p + q)), all in integers.

    Part ``pair``: each other source of the lang, by the sum over all kept terms (0 if none is kept). Part ``term``: the ``top``
    terms that the source has and that are likelier in it than in the lang. Ranks go by value, then by name in UTF-8.

    Null texts, langs and sources are read as ''. A group without terms has pairs and no terms; a lang of one source has no pairs. Repeated rows
    count as often as they come; an empty table gives no rows; other columns play no part. A text is held whole in a task.
    Returns lang, source, part, item, value, rank.
    """
    C.small_batches(docs.sparkSession)
    x = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])
    groups, found = entries(x, least)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = source_pairs(groups, found).withColumn("rank", F.row_number().over(order))
    terms = best_terms(found, top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionByName(terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(C.table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM docs
), terms AS (
  SELECT r, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words
), kept AS (
  SELECT lang, term, count(*) AS total FROM terms GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM terms SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), sources AS (
  SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS here, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 2)) // (l.n + 2 * l.v) AS q
  FROM sources s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), both_parts AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE here > 0 AND p > q
)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM both_parts
QUALIFY part = 'pair' OR rank <= 10
"""
