"""Operator 10: benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.op8_toxicity import _WORD, _lower

#: Words in half a passage; passages are two neighbouring halves, so they overlap by half.
HALF = 24
#: Rank of the sketch.
RANK = 64
#: Benchmark items searched at a time. They bound the vocabulary, and with it what is broadcast and what the driver decomposes:
#: at most 400,000 words of RANK numbers.
ITEMS, ITEM_BYTES = 5000, 2_000_000
#: Least share of an item's latent mass in a candidate. Its cosine plays no part: rare words beside a frequent item outweigh it.
MASS = 0.3
#: A copy has this share of the item in order; a paraphrase the lower one, and the answer.
COPY, PARAPHRASE, ANSWER_SHARE = 0.7, 0.5, 0.75
#: Words at an item's end that count as its answer.
ANSWER = 8
OCCURRENCE_SCHEMA = "ids binary, known binary, counts binary, n int, words binary, places binary"
HIT_SCHEMA = "doc_id long, item_id long, share double, answer_share double, at_word int, kind string"
_CHUNK = 512


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (letters and digits, lower case) and each document's first."""
    low = _lower(buf) if len(buf) else buf
    is_word, cut = _WORD[buf], np.zeros(len(buf) + 1, bool)
    cut[off] = True
    here, before = np.append(is_word, False), np.append(False, is_word)
    starts, ends = np.flatnonzero(here & (~before | cut)), np.flatnonzero(before & (~here | cut))
    return C.bytes_hashes(low, starts, ends), np.searchsorted(starts, off)


def _item_words(text: str) -> np.ndarray:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    return _words(buf, np.array([0, len(buf)]))[0]


class Occurrences:
    """The benchmark's words in the documents of one row of the table: document, place and word number."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.known = np.frombuffer(row["known"], bool)
        counts = np.frombuffer(row["counts"], np.int64)
        self.word = C.unplanes(row["words"], row["n"], np.int32)
        self.place = C.unplanes(row["places"], row["n"], np.int32)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])

    def halves(self, use: np.ndarray):
        """Used occurrences, the half passage of each, and the halves: document, number, whether the next follows."""
        at = np.flatnonzero(use[self.word])
        doc, number = self.doc[at], self.place[at] // HALF
        cut = C.group_starts(doc, number) if len(at) else np.zeros(0, bool)
        half = np.cumsum(cut) - 1
        d, n = doc[cut], number[cut]
        follows = np.append((d[1:] == d[:-1]) & (n[1:] == n[:-1] + 1), False) if len(d) else np.zeros(0, bool)
        return at, half, np.flatnonzero(cut), d, n, follows


def _sums(table: np.ndarray, which: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows table[which] over the groups that begin at ``first``, in pieces of HALF rows."""
    n = np.diff(np.append(first, len(which)))
    pieces = -(-n // HALF)
    begin = np.repeat(first, pieces) + HALF * C.ranges(np.zeros(len(first), np.int64), pieces)
    size = np.minimum(HALF, np.repeat(first + n, pieces) - begin)
    order = np.argsort(-size, kind="stable")
    out = np.empty((len(begin), table.shape[1]), table.dtype)
    for lo in range(0, len(order), _CHUNK):
        some = order[lo : lo + _CHUNK]
        at, left = begin[some], size[some]
        total = table[which[at]]
        for k in range(1, int(left[0])):
            m = int(np.searchsorted(-left, -k))
            total[:m] += table[which[at[:m] + k]]
        out[some] = total
    return out if len(out) == len(first) else np.add.reduceat(out, np.cumsum(pieces) - pieces, axis=0)


def _passages(halves: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Each half with the one that follows it."""
    out = halves.copy()
    k = np.flatnonzero(follows)
    out[k] += halves[k + 1]
    return out


def common_in_order(item: np.ndarray, words: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[int, int] = {}
    for k, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(item)) - 1
    row = full
    for w in words.tolist():
        m = masks.get(w)
        if m:
            u = row & m
            row = (row + u) | (row - u)
            row &= full
    return len(item) - row.bit_count()


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item, or a paraphrase with its answer.

    Passages of 2 * HALF words of all documents are rows of a TF-IDF matrix over the
    benchmark's words (inverse document frequency as 1 / sqrt(df), so that words that come
    together in a passage outweigh frequent ones). A one-pass randomised SVD (a Gaussian sketch
    of the Gram matrix, summed over all documents, then Nystrom's formula) gives the latent
    space. No word is left out, however frequent: an item in many documents makes its own words
    frequent. Items of more than 2 * HALF words are cut into passages too, any of which nominates
    the item. Passages with enough of an item's latent vector are candidates. Those with enough of
    its words are compared: the longest common subsequence of words, and that of the item's last
    words (its answer), decide. Words are runs of letters and digits in lower case.

    Null and empty texts and items hold nothing. Items of fewer than 6 words are too short
    to tell. Repeated items are found each, repeated rows of a doc_id too; a null doc_id comes
    back null. Other columns play no part. Empty tables give no rows.
    Returns doc_id, item_id, share, answer_share, at_word and kind (copy or paraphrase).
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    items = C.written(benchmark.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("text IS NOT NULL"))
    n, size = items.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // ITEMS), -(-(size or 0) // ITEM_BYTES), 1)
    out = None
    for k in range(blocks):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        found = _leaks_of(docs, [(r["item_id"], _item_words(r["text"])) for r in some.orderBy("item_id", "text").collect()], text, key)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of(docs: DataFrame, items: list, text: str, key: str) -> DataFrame:
    spark = docs.sparkSession
    items = [(i, w) for i, w in items if len(w) >= 6]
    if not items:
        return spark.createDataFrame([], HIT_SCHEMA)
    vocabulary = np.unique(np.concatenate([w for _, w in items]))
    size = len(vocabulary)
    item_ids = [i for i, _ in items]
    item_words = [np.searchsorted(vocabulary, w).astype(np.int32) for _, w in items]
    first_bits = np.zeros(1 << 16, bool)
    first_bits[(vocabulary >> np.uint64(48)).astype(np.int64)] = True

    def occur(batches):
        """Where the benchmark's words stand, about PACK_BYTES of text at a time."""
        for b in batches:
            ids, known = C.column_ids(b.column(0)), ~b.column(0).is_null().to_numpy(zero_copy_only=False)
            buf, off = C.column_bytes(b.column(1))
            at = 0
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(off, off[at] + C.PACK_BYTES, side="right")) - 1)
                words, first = _words(buf[off[at] : off[to]], off[at : to + 1] - off[at])
                some = np.flatnonzero(first_bits[(words >> np.uint64(48)).astype(np.int64)])
                number = np.minimum(np.searchsorted(vocabulary, words[some]), size - 1)
                good = vocabulary[number] == words[some]
                some, number = some[good], number[good].astype(np.int32)
                cut = np.searchsorted(some, first)
                counts = np.diff(cut)
                if len(some):
                    place = (some - np.repeat(first[:-1], counts)).astype(np.int32)
                    yield C.batch_of(OCCURRENCE_SCHEMA, [[ids[at:to].tobytes()], [known[at:to].tobytes()], [counts.tobytes()], [len(some)], [C.planes(number)], [C.planes(place)]])
                at = to

    seen = C.written(docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text")).mapInArrow(C.tidied(occur), OCCURRENCE_SCHEMA))

    def frequencies(batches):
        df = np.zeros(size, np.int64)
        for row in C.rows_of(batches):
            o = Occurrences(row)
            whole = (o.doc.astype(np.int64) << 32) + o.place // HALF
            pair = np.unique((np.cumsum(C.group_starts(whole)) - 1) * size + o.word)
            df += np.bincount(pair % size, minlength=size)
        used = np.flatnonzero(df)
        yield C.batch_of("word int, n long", [used, df[used]])

    counts = dict(seen.mapInArrow(C.tidied(frequencies), "word int, n long").groupBy("word").agg(F.sum("n")).collect())
    df = np.zeros(size)
    df[list(counts)] = list(counts.values())
    use = df > 0
    weight = np.where(use, 1 / np.sqrt(np.maximum(df, 1)), 0)
    rank = int(min(RANK, max(1, use.sum())))
    omega = np.random.default_rng(1).standard_normal((size, rank)).astype(np.float32)
    omega[~use] = 0
    model = spark.sparkContext.broadcast((use, weight.astype(np.float32), omega))

    def sketch(batches):
        use, weight, omega = model.value
        total = np.zeros((size, rank), np.float32)
        weighted = omega * weight[:, None]
        for row in C.rows_of(batches):
            o = Occurrences(row)
            at, half, first, _, _, follows = o.halves(use)
            if not len(at):
                continue
            word = o.word[at]
            z = _passages(_sums(weighted, word, first), follows)
            # a word of a half is in the passage that begins there, and in the one before
            back = z.copy()
            k = np.flatnonzero(follows)
            back[k + 1] += z[k]
            order = np.argsort(word, kind="stable")
            cut = np.flatnonzero(C.group_starts(word[order]))
            total[word[order][cut]] += _sums(back, half[order], cut) * weight[word[order][cut]][:, None]
        for lo in range(0, size, _CHUNK):
            part = total[lo : lo + _CHUNK]
            if part.any():
                yield C.batch_of("chunk int, part binary", [[lo], [part.tobytes()]])

    def added(batches):
        total, chunk = None, None
        for b in batches:
            for k in range(b.num_rows):
                part = np.frombuffer(b.column(1)[k].as_py(), np.float32).astype(np.float64)
                total, chunk = part if total is None else total + part, b.column(0)[k].as_py()
        yield C.batch_of("chunk int, part binary", [[chunk], [total.tobytes()]])

    parts = seen.mapInArrow(C.tidied(sketch), "chunk int, part binary").groupBy("chunk").applyInArrow(C.per_group(added), "chunk int, part binary").collect()
    y = np.zeros((size, rank))
    for r in parts:
        part = np.frombuffer(r["part"], np.float64).reshape(-1, rank)
        y[r["chunk"] : r["chunk"] + len(part)] = part
    # Nystrom: G = Y (omega' Y)^-1 Y', with a small shift for stability
    shift = 1e-6 * max(np.abs(y).max(), 1e-9)
    y += shift * omega
    core = omega.T.astype(np.float64) @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-9 * max(values.max(), 1e-12)
    left, sigma, _ = np.linalg.svd(y @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    latent = left[:, sigma > 1e-4 * sigma[0]] * weight[:, None] if len(sigma) and sigma[0] > 0 else np.zeros((size, 1))
    latent = latent.astype(np.float32)
    # a long item is searched by its passages, any of which nominates it
    pieces = [(i, w[x : x + 2 * HALF]) for i, w in enumerate(item_words) for x in [*range(0, len(w) - 2 * HALF, 2 * HALF), max(0, len(w) - 2 * HALF)]]
    piece_item = np.array([i for i, _ in pieces])
    items_latent = np.stack([latent[w].sum(0) for _, w in pieces])
    norms = np.sqrt((items_latent**2).sum(1))
    scaled = items_latent / np.maximum(norms, 1e-12)[:, None]
    finder = spark.sparkContext.broadcast((use, latent, scaled, norms, item_words, item_ids))

    lengths = np.array([len(w) for w in item_words])
    # (item, word) and how often the item has the word
    pairs, times = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + np.concatenate(item_words), return_counts=True)

    def held(o, doc, item, low, high):
        """Regions with enough of their item's words, in any order: no others can have them in order."""
        reach = lengths[item]
        where = (o.doc.astype(np.int64) << 32) + o.place
        x = np.searchsorted(where, (doc << 32) + np.maximum(low * HALF - reach, 0))
        y = np.searchsorted(where, (doc << 32) + (high + 2) * HALF + reach)
        out, edges, lo = np.zeros(len(doc), bool), np.concatenate([[0], np.cumsum(y - x)]), 0
        while lo < len(doc):  # some words at a time
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 500_000, side="right")) - 1)
            region = np.repeat(np.arange(lo, hi), (y - x)[lo:hi])
            word = o.word[x[region] + np.arange(len(region)) + edges[lo] - edges[region]]
            pair = item[region] * size + word
            at = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            good = pairs[at] == pair
            one = np.unique((region[good] - lo) * len(pairs) + at[good])
            total = np.bincount(one // len(pairs), weights=times[one % len(pairs)], minlength=hi - lo)
            out[lo:hi] = total >= PARAPHRASE * reach[lo:hi]
            lo = hi
        return out

    def search(batches):
        use, latent, scaled, norms, item_words, item_ids = finder.value
        for row in C.rows_of(batches):
            o = Occurrences(row)
            at, half, first, doc, number, follows = o.halves(use)
            if not len(at):
                continue
            vectors = _passages(_sums(latent, o.word[at], first), follows)
            found = []
            for lo in range(0, len(vectors), 4096):
                near = vectors[lo : lo + 4096] @ scaled.T
                p, i = np.nonzero((near >= MASS * norms) & (near > 1e-9))
                found.append(np.stack([doc[lo + p], piece_item[i], number[lo + p]], 1))
            found = np.concatenate(found)
            if not len(found):
                continue
            # neighbouring passages of one document and item are one region
            found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
            cut = C.group_starts(found[:, 0], found[:, 1])
            cut[1:] |= found[1:, 2] > found[:-1, 2] + 2 + np.maximum(0, lengths[found[1:, 1]] // HALF - 2)
            lo_of = np.flatnonzero(cut)
            hi_of = np.append(lo_of[1:], len(found)) - 1
            some = held(o, found[lo_of, 0], found[lo_of, 1], found[lo_of, 2], found[hi_of, 2])
            lo_of, hi_of = lo_of[some], hi_of[some]
            best: dict[tuple[int, int], tuple] = {}
            for a, z in zip(lo_of, hi_of, strict=True):
                d, i = int(found[a, 0]), int(found[a, 1])
                item = item_words[i]
                begin, end = int(found[a, 2]) * HALF - len(item), (int(found[z, 2]) + 2) * HALF + len(item)
                one, two = o.first[d], o.first[d + 1]
                places = o.place[one:two]
                x, to = one + np.searchsorted(places, begin), one + np.searchsorted(places, end)
                member = np.isin(o.word[x:to], item)
                words, where = o.word[x:to][member], o.place[x:to][member]
                # windows of one and a half times the item's length
                span, step = len(item) * 3 // 2, max(1, len(item) // 4)
                starts = np.arange(begin, max(begin + 1, end - span + step), step)
                u, v = np.searchsorted(where, starts), np.searchsorted(where, starts + span)
                enough = v - u >= PARAPHRASE * len(item)
                for u, v in dict.fromkeys(zip(u[enough].tolist(), v[enough].tolist(), strict=True)):
                    share = common_in_order(item, words[u:v]) / len(item)
                    if share >= PARAPHRASE and share > best.get((d, i), (0,))[0]:
                        tail = item[-ANSWER:]
                        answer = common_in_order(tail, words[u:v]) / len(tail)
                        if share >= COPY or answer >= ANSWER_SHARE:
                            best[d, i] = (share, answer, int(where[u]))
            rows = [(d, i, *x) for (d, i), x in sorted(best.items())]
            if rows:
                d, i, share, answer, place = zip(*rows, strict=True)
                d = list(d)
                yield C.batch_of(HIT_SCHEMA, [[int(o.ids[x]) if o.known[x] else None for x in d], [item_ids[x] for x in i], list(share), list(answer), list(place), ["copy" if x >= COPY else "paraphrase" for x in share]])

    return seen.mapInArrow(C.tidied(search), HIT_SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs without a leak, with all their columns; rows with a null id stay."""
    leak = "_leak"
    while leak in docs.columns:
        leak += "_"
    gone = C.written(leaks(docs, benchmark, key=key).filter("doc_id IS NOT NULL").select(F.col("doc_id").alias(leak)).distinct())
    side = F.broadcast(gone) if gone.count() <= 100_000 else gone
    return docs.join(side, docs[key] == F.col(leak), "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
