"""Operator 3: n-gram Jaccard join, by prefix filters under several global token orders."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm.components import components

#: Token orders: all put rarer tokens first, each breaks ties by its own hash.
ORDERS = 3
#: Rounds that look for likely partners before all pairs are formed, and the lines along which neighbours are sought.
ROUNDS, LINES = 3, 4
#: Tokens of each document that look for partners in the first of these rounds.
LEADS = 6
#: First shared prefix tokens under each order, by which orders are intersected and a pair is formed at its first common token only.
FIRST = 6
#: Counters of a set's profile.
PROFILE = 128
META_SCHEMA = "row_id long, doc_id long, n_shingles long, s1 long, s2 long"
PREFIX_SCHEMA = "pack_id long, n int, entries binary, n_docs int, docs binary"
PAIR_SCHEMA = "a long, b long"
SET_SCHEMA = "pack_b long, a long, n int, members binary, bs binary"
LINK_SCHEMA = "a long, b long"
#: What a class shows of itself: its profile, and for each order its first shared prefix tokens, their places and the place of the next one (0: none).
_CLASS = np.dtype([("node", "<i8"), ("n", "<i4"), ("profile", "u1", (PROFILE,)), ("token", "<u8", (ORDERS, FIRST)), ("place", "<i4", (ORDERS, FIRST + 1))])
#: An entry under a prefix token of the first order.
_ENTRY = np.dtype([("part", "<i8"), ("place", "<i4"), ("slot", "u1"), ("of", _CLASS)])


def _by_document(doc: np.ndarray, value: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order by document, then value, then key: one sort of what fits in 64 bits, unless that leaves a tie of keys."""
    both = (doc.astype(np.uint64) << np.uint64(64 - C.PLACE_BITS)) | (value >> np.uint64(C.PLACE_BITS))
    order = np.argsort(both)
    tied = np.flatnonzero(~C.group_starts(both[order]))
    if len(tied) and (key[order[tied]] != key[order[tied - 1]]).any():
        return np.lexsort((key, value, doc))
    return order


class Sets:
    """Distinct shingles of each document of a pack: doc and key, sorted by both."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, size: int):
        buf = C.lowered(buf)
        starts, ends, first = C.word_bounds(buf, offsets)
        words = C.bytes_hashes(buf, starts, ends)
        counts = np.diff(first)
        whole = np.maximum(counts - size + 1, 0)
        at, doc = C.ranges(first[:-1], whole), np.repeat(np.arange(len(counts)), whole)
        # a document with fewer words has its whole sequence as one shingle
        few = np.flatnonzero((counts > 0) & (counts < size))
        key = np.concatenate([C.run_hashes(words, size)[at], C.span_hashes(words, first[few], first[few + 1])])
        doc = np.concatenate([doc, few])
        order = _by_document(doc, key, key)
        key, doc = key[order], doc[order]
        keep = C.group_starts(doc, key) if len(key) else np.zeros(0, bool)
        self.key, self.doc = key[keep], doc[keep]
        self.first = np.searchsorted(self.doc, np.arange(len(counts) + 1))
        self.size = np.diff(self.first)

    def signatures(self) -> np.ndarray:
        """Two 64-bit sums over each set, and its size."""
        sums = [np.concatenate([[np.uint64(0)], np.cumsum(x)]) for x in (C.mix(self.key), C.mix(self.key ^ np.uint64(0x5851F42D4C957F2D)))]
        return np.stack([*(s[self.first[1:]] - s[self.first[:-1]] for s in sums), self.size.astype(np.uint64)])


def _prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (n * num + den - 1) // den + 1


def _small_enough(n_small, n_large, num, den):
    return den * n_small >= num * n_large


def _apart(profile: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A lower bound of the size of the symmetric difference of two sets: of the counts of their tokens by hash."""
    return np.abs(profile[i].astype(np.int16) - profile[j]).sum(1, dtype=np.int64)


def _in_all_orders(cls: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """False where under some order the pair's prefixes have no common token, or only one too late for the overlap."""
    use = np.ones(len(i), bool)
    n, total = cls["n"].astype(np.int64), cls["n"][i].astype(np.int64) + cls["n"][j]
    for o in range(1, ORDERS):
        token, place = cls["token"][:, o], cls["place"][:, o].astype(np.int64)
        same = (token[i][:, :, None] == token[j][:, None, :]) & (token[i] != 0)[:, :, None]
        met = same.any((1, 2))
        a = same.any(2).argmax(1)
        b = same[np.arange(len(i)), a].argmax(1)
        most = np.minimum(n[i] - place[i, a], n[j] - place[j, b])
        # not among the first ones: then it is a later one of either
        later = [np.where(place[x, FIRST] > 0, np.minimum(n[x] - place[x, FIRST], n[y] - place[y, 0]), 0) for x, y in ((i, j), (j, i))]
        most = np.where(met, most, np.maximum(*later))
        use &= most * (num + den) >= num * total
    return use


def _met_first(token: np.ndarray, slot: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """False where an earlier prefix token of the first order is common as well: the pair is formed there."""
    k = np.arange(FIRST)
    a = np.where(k < slot[i][:, None], token[i, 0], 0)
    b = np.where(k < slot[j][:, None], token[j, 0], 1)
    return ~(a[:, :, None] == b[:, None, :]).any((1, 2))


def ngram_jaccard_join(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id", packs: DataFrame | None = None, spanning: bool = False):
    """Documents whose sets of ``size``-word shingles have a Jaccard similarity of num / den or more.

    Exact: equal sets form a class at once; between classes the candidates are those that
    share a prefix token under each of ORDERS global orders (rarest first by document
    frequency over all classes, ties by a different hash in each). Classes meet under the tokens of the
    first order; the other orders are intersected there, by the first tokens under each that a
    class carries, so a pair is written once, and only if no order excludes it. It also has to pass the size and
    position filters and a bound from profiles (counts of a set's tokens by hash: they differ by
    no more than the sets do). Candidates are then verified on whole sets. With ``spanning``,
    for components alone, rounds of likely partners (under each token the middle of its group, and
    neighbours by profile, between different parts) come first; in the end pairs are formed only
    between parts that are still apart, so a large group of near copies is not compared all with all.

    Words are runs of bytes outside [\\x20\\x09-\\x0D], A-Z lower-cased; a document with fewer
    words has its whole sequence as its one shingle, one without words (or a null text) has an
    empty set and no link. Repeated rows of a doc_id are rows of their own; a null doc_id gets
    a component like any other but never names one unless alone.

    Returns (members, links): members has row_id, doc_id, n_shingles, class_id (a row_id) and
    component_id (smallest doc_id of the component); links has verified pairs of classes a < b, each
    once: all of them, or with ``spanning`` a spanning part. Documents of one class are linked
    too, by equal sets; links between documents are members joined with links on class_id.
    """
    spark = docs.sparkSession if docs is not None else packs.sparkSession
    if packs is None:
        packs = C.packed(docs, text, key, also=lambda buf, offsets: Sets(buf, offsets, size).signatures().tobytes())

    def meta(batches):
        for row in C.rows_of(batches):
            ids = np.frombuffer(row["ids"], np.int64)
            s1, s2, n = np.frombuffer(row["also"], np.uint64).reshape(3, -1).view(np.int64)
            yield C.batch_of(META_SCHEMA, [(row["pack_id"] << C.PLACE_BITS) + np.arange(len(ids)), pa.array(ids, pa.int64(), mask=ids == C.NULL_ID), n, s1, s2])

    rows = packs.select("pack_id", "ids", "also").mapInArrow(C.tidied(meta), META_SCHEMA)
    classes = rows.filter("n_shingles > 0").groupBy("s1", "s2", "n_shingles").agg(F.min("row_id").alias("class_id"), F.min("doc_id").alias("least_id"))
    classes = C.written(classes)
    kept = classes.groupBy(F.shiftright("class_id", C.PLACE_BITS).alias("pack_id")).agg(F.sort_array(F.collect_list(F.col("class_id").bitwiseAND(F.lit((1 << C.PLACE_BITS) - 1)).cast("int"))).alias("kept"))
    light = packs.select("pack_id", "ids", "lens", "nulls", "data", "n_bytes").join(C.written(kept).hint("merge"), "pack_id")
    nb = C.buckets_for(packs, 1 / 6)

    def sets_of(row) -> Sets:
        """Only of classes' first documents."""
        pack = C.Pack(row)
        sets = Sets(pack.buf, pack.offsets, size)
        keep = np.zeros(len(pack.ids), bool)
        keep[row["kept"]] = True
        keep = keep[sets.doc]
        sets.key, sets.doc = sets.key[keep], sets.doc[keep]
        sets.first = np.searchsorted(sets.doc, np.arange(len(pack.ids) + 1))
        sets.size = np.diff(sets.first)
        return sets

    def counted(batches):
        for row in C.rows_of(batches):
            keys = np.sort(sets_of(row).key)
            cut = np.flatnonzero(C.group_starts(keys)) if len(keys) else np.zeros(0, np.int64)
            n = np.diff(np.append(cut, len(keys))).astype(np.uint16)
            if (out := C.entries(row["pack_id"], keys[cut], [n], nb)) is not None:
                yield out

    def rarity(keys, who, extras):
        order = np.argsort(keys, kind="stable")
        cut = C.group_starts(keys[order])
        df = np.add.reduceat(extras[0][order].astype(np.int64), np.flatnonzero(cut))
        rank = np.where(df == 1, 0, np.minimum(255, 1 + 4 * np.log2(df))).astype(np.uint8)
        out = np.empty(len(keys), np.uint8)
        out[order] = rank[np.cumsum(cut) - 1]
        return out

    ranks = C.answered(light.mapInArrow(C.tidied(counted), C.ENTRY_SCHEMA), [np.uint16], rarity)

    def prefixes(batches):
        """Prefix tokens of the first order that several classes have, and what each class shows of itself."""
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for row in C.rows_of(batches):
            sets = sets_of(row)
            order = np.argsort(sets.key)
            which = np.empty(len(order), np.int64)
            which[order] = np.cumsum(C.group_starts(sets.key[order])) - 1 if len(order) else order
            rank = C.answer_bytes(row["answers"])[which].astype(np.uint64)
            length = _prefix_length(sets.size, num, den)
            docs = np.zeros(len(sets.size), _CLASS)
            docs["node"], docs["n"] = (row["pack_id"] << C.PLACE_BITS) + np.arange(len(docs)), sets.size
            counts = np.bincount(sets.doc * PROFILE + (sets.key >> np.uint64(57)).astype(np.int64), minlength=len(docs) * PROFILE)
            docs["profile"] = np.minimum(counts, 255).reshape(-1, PROFILE)
            for o in range(ORDERS):
                tie = C.mix(sets.key ^ np.uint64(o + 1))
                order = _by_document(sets.doc, (rank << np.uint64(56)) | (tie >> np.uint64(8)), sets.key)
                place = np.arange(len(order)) - sets.first[sets.doc]
                use = (place < length[sets.doc]) & (rank[order] > 0)
                at, doc, place = order[use], sets.doc[use], place[use]
                slot = np.arange(len(at)) - np.searchsorted(doc, np.arange(len(docs)))[doc]
                token = C.mix(sets.key[at])
                few = slot < FIRST
                docs["token"][doc[few], o, slot[few]] = token[few]
                few = slot <= FIRST
                docs["place"][doc[few], o, slot[few]] = place[few]
                if o == 0:
                    entry = token, doc, place, slot
            token, doc, place, slot = entry
            if len(token):
                used, which = np.unique(doc, return_inverse=True)
                blob = b"".join([_planes(token), _planes(which.astype(np.int32)), _planes(place.astype(np.int32)), _planes(np.minimum(slot, 255).astype(np.uint8))])
                yield C.batch_of(PREFIX_SCHEMA, [[row["pack_id"]], [len(token)], [press.compress(blob)], [len(used)], [press.compress(_planes(docs[used]))]])

    held = C.written(light.join(ranks.hint("merge"), "pack_id").mapInArrow(C.tidied(prefixes), PREFIX_SCHEMA))
    C.dropped(ranks)

    def entries_of(slots: int):
        """Entries of the first so many shared tokens of each class, with its part."""

        def send(batches):
            import zstandard

            opener = zstandard.ZstdDecompressor()
            for row in C.rows_of(batches):
                raw, n, at, out = np.frombuffer(opener.decompress(row["entries"]), np.uint8), row["n"], 0, []
                for kind in (np.uint64, np.int32, np.int32, np.uint8):
                    width = np.dtype(kind).itemsize
                    out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).reshape(n))
                    at += n * width
                token, which, place, slot = out
                docs = np.ascontiguousarray(np.frombuffer(opener.decompress(row["docs"]), np.uint8).reshape(_CLASS.itemsize, row["n_docs"]).T).view(_CLASS).reshape(-1)
                part = docs["node"].copy()
                if row["parts"]:
                    pairs = np.array(sorted((x["node"], x["root"]) for x in row["parts"]), np.int64)
                    at = np.minimum(np.searchsorted(pairs[:, 0], part), len(pairs) - 1)
                    part = np.where(pairs[at, 0] == part, pairs[at, 1], part)
                some = np.flatnonzero(slot < slots) if slots else np.arange(n)
                some = some[np.argsort(token[some], kind="stable")]
                entry = np.zeros(len(some), _ENTRY)
                entry["part"], entry["place"], entry["slot"], entry["of"] = part[which[some]], place[some], slot[some], docs[which[some]]
                if (out := C.entries(row["pack_id"], token[some], [entry], nb)) is not None:
                    yield out

        return send

    def passing(entry, i, j):
        """Which pairs of a token pass all filters."""
        cls = entry["of"]
        n, place = cls["n"].astype(np.int64), entry["place"].astype(np.int64)
        total = n[i] + n[j]
        most = np.minimum(n[i] - place[i], n[j] - place[j])
        use = _small_enough(np.minimum(n[i], n[j]), np.maximum(n[i], n[j]), num, den) & (most * (num + den) >= num * total) & (entry["part"][i] != entry["part"][j])
        use = np.flatnonzero(use)
        apart = _apart(cls["profile"], i[use], j[use])
        near = (total[use] - apart) * (num + den) >= 2 * num * total[use]
        use, apart = use[near], apart[near]
        good = _in_all_orders(cls, i[use], j[use], num, den)
        return use[good], apart[good]

    def likely(keys, entry):
        """Of each token's classes the middle one with all others, and neighbours by profile: between two parts only the nearest pair."""
        profile, node = entry["of"]["profile"], entry["of"]["node"]
        order = np.lexsort((node, keys))
        cut = C.group_starts(keys[order])
        begin, group = np.flatnonzero(cut), np.cumsum(cut) - 1
        mean = np.add.reduceat(profile[order].astype(np.float32), begin, axis=0) / np.diff(np.append(begin, len(keys)))[:, None]
        off = np.empty(len(keys))
        for lo in range(0, len(keys), 50_000):
            off[lo : lo + 50_000] = np.abs(profile[order[lo : lo + 50_000]] - mean[group[lo : lo + 50_000]]).sum(1)
        middle = order[np.lexsort((off, group))[begin]]
        i, j = [middle[group]], [order]
        signs = np.random.default_rng(2).choice(np.array([-1, 1], np.int32), (PROFILE, LINES))
        for line in [entry["of"]["n"], *(profile.astype(np.int32) @ signs).T]:
            order = np.lexsort((node, line, keys))
            for back in (1, 2):
                same = keys[order[back:]] == keys[order[:-back]]
                i.append(order[:-back][same])
                j.append(order[back:][same])
        i, j = np.concatenate(i), np.concatenate(j)
        found = []
        for lo in range(0, len(i), 50_000):
            use, apart = passing(entry, i[lo : lo + 50_000], j[lo : lo + 50_000])
            found.append(np.stack([i[lo + use], j[lo + use], apart], 1))
        i, j, apart = np.concatenate(found).T if found else np.zeros((3, 0), np.int64)
        p, q = np.minimum(entry["part"][i], entry["part"][j]), np.maximum(entry["part"][i], entry["part"][j])
        order = np.lexsort((node[j], node[i], apart, q, p))
        first = order[C.group_starts(p[order], q[order])] if len(order) else order
        return np.stack([node[i[first]], node[j[first]]], 1)

    def all_pairs(keys, entry):
        """Pairs of one token between different parts that pass all filters, at their first common token."""
        order = np.lexsort((entry["of"]["node"], entry["part"], keys))
        k, entry = keys[order], entry[order]
        node, slot, token = entry["of"]["node"], entry["slot"].astype(np.int64), entry["of"]["token"]
        group = C.group_starts(k)
        ends = np.append(np.flatnonzero(group)[1:], len(k))[np.cumsum(group) - 1]
        same = C.group_starts(k, entry["part"])
        after = np.append(np.flatnonzero(same)[1:], len(k))[np.cumsum(same) - 1]
        count = ends - after
        found = [np.zeros((0, 2), np.int64)]
        edges = np.concatenate([[0], np.cumsum(count)])
        lo = 0
        while lo < len(k):  # some pairs at a time
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + 100_000, side="right")) - 1)
            i, j = np.repeat(np.arange(lo, hi), count[lo:hi]), C.ranges(after[lo:hi], count[lo:hi])
            for x in range(0, len(i), 100_000):
                u, v = i[x : x + 100_000], j[x : x + 100_000]
                use, _ = passing(entry, u, v)
                u, v = u[use], v[use]
                use = _met_first(token, slot, u, v)
                u, v = node[u[use]], node[v[use]]
                found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1))
            lo = hi
        return np.unique(np.concatenate(found), axis=0)

    def paired(parts, make, slots: int = 0):
        """Pairs of classes made under each token; parts (node, root) are those joined before."""
        if parts is None:
            known = held.withColumn("parts", F.lit(None))
        else:
            by_pack = parts.groupBy(place_of("node").alias("pack_id")).agg(F.collect_list(F.struct("node", "root")).alias("parts"))
            known = held.join(by_pack.hint("merge"), "pack_id", "left")

        def reduce(batches):
            rows = list(C.rows_of(batches))
            keys = np.concatenate([C.unplanes(r["keys"], r["n"], np.uint64) for r in rows])
            pairs = make(keys, C.extras_of(rows, [_ENTRY])[0])
            for lo in range(0, len(pairs), 100_000):
                yield C.batch_of(PAIR_SCHEMA, [pairs[lo : lo + 100_000, 0], pairs[lo : lo + 100_000, 1]])

        sent = known.mapInArrow(C.tidied(entries_of(slots)), C.ENTRY_SCHEMA)
        return sent.groupBy("bucket").applyInArrow(C.per_group(reduce), PAIR_SCHEMA).distinct()

    place_of = lambda c: F.shiftright(c, C.PLACE_BITS)

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs that pass on whole sets. a's set goes once to each pack that has partners."""
        pairs = C.written(pairs)
        ask = pairs.groupBy("a", place_of("b").alias("pack_b")).agg(F.sort_array(F.collect_set("b")).alias("bs"))
        ask = ask.groupBy(place_of("a").alias("pack_id")).agg(F.collect_list(F.struct("a", "pack_b", "bs")).alias("asks"))

        def send(batches):
            for row in C.rows_of(batches):
                sets = sets_of(row)
                out = []
                for x in row["asks"]:
                    d = x["a"] & ((1 << C.PLACE_BITS) - 1)
                    members = sets.key[sets.first[d] : sets.first[d + 1]]
                    out.append([x["pack_b"], x["a"], len(members), C.planes(members), np.array(x["bs"], np.int64).tobytes()])
                    if len(out) == 500:
                        yield C.batch_of(SET_SCHEMA, [list(c) for c in zip(*out, strict=True)])
                        out = []
                if out:
                    yield C.batch_of(SET_SCHEMA, [list(c) for c in zip(*out, strict=True)])

        def check(left, right):
            """One pack and the sets sent to it."""
            sets = None
            for row in C.rows_of(left):
                sets = sets_of(row)
            found = []
            for row in C.rows_of(right):
                members = C.unplanes(row["members"], row["n"], np.uint64)
                for b in np.frombuffer(row["bs"], np.int64):
                    d = int(b) & ((1 << C.PLACE_BITS) - 1)
                    other = sets.key[sets.first[d] : sets.first[d + 1]]
                    at = np.minimum(np.searchsorted(members, other), len(members) - 1)
                    both = int((members[at] == other).sum())
                    if den * both >= num * (len(members) + len(other) - both):
                        found.append((row["a"], int(b)))
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        sent = light.join(ask.hint("merge"), "pack_id").mapInArrow(C.tidied(send), SET_SCHEMA)
        needed = light.join(pairs.select(place_of("b").alias("pack_id")).distinct().hint("merge"), "pack_id", "left_semi")
        out = C.written(needed.groupBy("pack_id").cogroup(sent.groupBy("pack_b")).applyInArrow(lambda l, r: check(l.to_batches(), r.to_batches()), LINK_SCHEMA))
        C.dropped(pairs)
        return out

    links, joined = None, None
    for k in range(ROUNDS if spanning else 0):
        found = verified(paired(joined, likely, LEADS if k == 0 else 0))
        new = C.written(components(found if joined is None else found.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b")))))
        if joined is not None:
            C.dropped(joined)
        links, joined = found if links is None else links.unionByName(found), new
        if found.isEmpty():
            break
    rest = verified(paired(joined, all_pairs))
    links = rest if links is None else C.written(links.unionByName(rest))
    C.dropped(held)
    joined = components(links)
    named = classes.join(joined, classes.class_id == joined.node, "left").withColumn("root", F.coalesce("root", "class_id"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "root").select("s1", "s2", "n_shingles", "class_id", "root", "component_id")
    some = rows.filter("n_shingles > 0").join(named, ["s1", "s2", "n_shingles"]).select("row_id", "doc_id", "n_shingles", "class_id", "root", "component_id")
    none = rows.filter("n_shingles = 0").select("row_id", "doc_id", "n_shingles", F.col("row_id").alias("class_id"), F.col("row_id").alias("root"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none), links


KEPT_SCHEMA = "doc_id long, text string, rest string"


def near_duplicate_filter(docs: DataFrame, size: int = 5, num: int = 8, den: int = 10, text: str = "text", key: str = "doc_id", carry: list[str] = ()) -> DataFrame:
    """One row of each component of ngram_jaccard_join: that of least doc_id (null last), of equal ones the first.

    Rows with empty sets all stay. Returns doc_id, text and rest (JSON of the carried columns).
    """
    packs = C.packed(docs, text, key, carry, also=lambda buf, offsets: Sets(buf, offsets, size).signatures().tobytes())
    members, _ = ngram_jaccard_join(None, size, num, den, packs=packs, spanning=True)
    first = members.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first"))
    place = F.col("first.row_id").bitwiseAND(F.lit((1 << C.PLACE_BITS) - 1)).cast("int")
    stay = C.written(first.groupBy(F.shiftright("first.row_id", C.PLACE_BITS).alias("pack_id")).agg(F.sort_array(F.collect_list(place)).alias("stay")))

    def rows(batches):
        for row in C.rows_of(batches):
            pack, stay = C.Pack(row), pa.array(row["stay"], pa.int32())
            texts = C.strings(pack.buf, pack.offsets, nulls=pack.nulls)
            yield C.batch_of(KEPT_SCHEMA, [x.take(stay) for x in (pack.id_column(), texts, pack.rest())])

    return packs.drop("also").join(stay.hint("merge"), "pack_id").mapInArrow(C.tidied(rows), KEPT_SCHEMA)


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = ngram_jaccard_join(C.table(spark, sf_dir, "documents"), size=3, num=9, den=10, spanning=True)
    return members.select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
                      WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_of AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN least_of ON a = doc_id
"""
