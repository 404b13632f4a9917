"""Operators with one right answer, against brute force on small fixtures."""

from __future__ import annotations

import hashlib
import json
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import op4_suffix
from tidemark.llm.components import components
from tidemark.llm.op1_substring import substring_dedup
from tidemark.llm.op2_bpe import bpe_encode, default_tokenizer
from tidemark.llm.op3_jaccard import near_duplicate_filter, ngram_jaccard_join
from tidemark.llm.op4_suffix import suffix_dedup
from tidemark.llm.op7_topk import exact_top_k
from tidemark.llm.op9_urls import url_filter

#: An extra column with a name that operators use inside.
DOCS = "doc_id long, text string, pack_id string"


def corpus(seed: int = 1) -> list[tuple]:
    """Copies, near copies, shared passages, nulls, empty and repeated texts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(25), text(80)
    out = [text(rng.randint(1, 120)) for _ in range(20)]
    out += [f"{text(rng.randint(0, 20))} {passage}\t{text(rng.randint(0, 20))}" for _ in range(8)]
    for _ in range(8):
        w = base.split()
        w[rng.randrange(len(w))] = "odd"
        out.append(" ".join(w))
    out += [base, base, base.upper(), "", None, "   ", "ab", "ab", text(2500), "x" * 500, "x" * 300, "é" * 90]
    rows = [(k, t, "clash") for k, t in enumerate(out)]
    rng.shuffle(rows)
    return rows + [(None, base, "clash"), (5, out[5], "clash"), (3, "another text with the id of another row", None)]


def covered(rows, tokens, n):
    """Per row the mask of tokens under a window that starts in a smaller id; null ranks last."""
    rank = lambda d: float("inf") if d is None else d
    least: dict = {}
    for d, t in rows:
        t = tokens(t)
        for p in range(len(t) - n + 1):
            w = tuple(t[p : p + n])
            least[w] = min(least.get(w, float("inf")), rank(d))
    out = []
    for d, t in rows:
        t = tokens(t)
        mask = [False] * len(t)
        for p in range(len(t) - n + 1):
            if least[tuple(t[p : p + n])] < rank(d):
                mask[p : p + n] = [True] * n
        out.append((d, t, mask))
    return out


def words_of(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("window", [6, 7, 20])
def test_substring_dedup(spark, window):
    rows = corpus()
    got = substring_dedup(spark.createDataFrame(rows, DOCS).repartition(3), window).collect()
    want = [(d, len(t), sum(m), b" ".join(w for w, x in zip(t, m) if not x).decode()) for d, t, m in covered([r[:2] for r in rows], words_of, window)]
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"] or "") for r in got), key=key) == sorted(want, key=key)


def test_suffix_dedup(spark):
    rows = corpus(2)
    got = suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), 12, 6).collect()
    want = []
    for d, t, m in covered([r[:2] for r in rows], lambda t: (t or "").encode(), 12):
        spans = sum(a and not b for a, b in zip(m, [False, *m]))
        want.append((d, len(t), sum(m), spans, hashlib.sha256(bytes(b for b, x in zip(t, m) if not x)).hexdigest()))
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("depth,digit,slices", [(12, 12, 1), (12, 1, 4), (9, 8, 2), (1, 1, 2), (50, 16, 5), (30, 16, 3)])
@pytest.mark.parametrize("every", [1, 6])
@pytest.mark.parametrize("ranges", [3])
def test_suffix_digits_and_slices(spark, monkeypatch, depth, digit, slices, ranges, every):
    """Any digits, slices and shares of chosen suffixes; fewer ranges than buckets."""
    monkeypatch.setattr(C, "BUCKET_KEYS", 300)
    monkeypatch.setattr(op4_suffix, "RANGES", ranges)
    rows = corpus(3)
    got = suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3), depth, digit, slices=slices, every=every).collect()
    want = [(d, len(t), sum(m), bytes(b for b, x in zip(t, m) if not x)) for d, t, m in covered([r[:2] for r in rows], lambda t: (t or "").encode(), depth)]
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [3, 8, 16, 50])
def test_radix_order_is_byte_order(size):
    """Suffixes stand in the order of their bytes, equal ones in order of place; buckets are ranges of that order."""
    rng = np.random.default_rng(size)
    buf = np.concatenate([rng.choice(np.frombuffer(b"ab\x00\xff", np.uint8), 3000), np.zeros(200, np.uint8), np.frombuffer(b"abc" * 300, np.uint8)])
    at, data = np.arange(len(buf) - size + 1), buf.tobytes()
    order, new = op4_suffix.radix_order(op4_suffix.words_at(buf, at, size))
    want = sorted(at.tolist(), key=lambda k: (data[k : k + size], k))
    assert order.tolist() == want
    assert new.tolist() == [k == 0 or data[a : a + size] != data[want[k - 1] : want[k - 1] + size] for k, a in enumerate(want)]
    drawn = op4_suffix.words_at(buf, at[::7], min(size, 16))
    deal = op4_suffix.Deal.of(drawn if len(drawn) > 1 else [*drawn, np.zeros_like(drawn[0])], 20, 1, 3)
    whole = op4_suffix.Sorted(buf, at, size, deal)
    assert len(set(whole.bucket.tolist())) > 3 and (np.diff(whole.bucket) >= 0).all()
    parts = [op4_suffix.Sorted(buf, at, size, deal, part) for part in range(3)]
    assert np.concatenate([p.bucket for p in parts]).tolist() == whole.bucket.tolist()
    assert np.concatenate([p.words[0] for p in parts]).tolist() == whole.words[0].tolist()


def test_groups_that_have_a_word_in_common_skip_it(monkeypatch):
    """Seven words, equal but for the first and the last: two sorts of all rows and what is left of a word, not one for every few bits."""
    rng, sorted_rows = np.random.default_rng(4), []
    starts = C.group_starts
    monkeypatch.setattr(op4_suffix.C, "group_starts", lambda *c: sorted_rows.append(len(c[0])) or starts(*c))
    words = [rng.integers(0, 50, 4000).astype(np.uint64) << np.uint64(40), *[np.full(4000, 7, np.uint64)] * 5, rng.integers(0, 3, 4000).astype(np.uint64)]
    order, new = op4_suffix.radix_order(words)
    want = np.lexsort((np.arange(4000), words[6], words[0]))
    assert order.tolist() == want.tolist() and new.sum() == len(set(zip(words[0].tolist(), words[6].tolist(), strict=True)))
    assert sum(sorted_rows) <= 5 * 4000


def test_near_copies_are_settled_before_the_last_pass(spark, monkeypatch):
    """Near copies leave only suffixes beside their edits; one that also stands in other words is still found."""
    rng, sorted_on, dropped = random.Random(11), [], C.dropped
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(1500)]
    rows = []
    for k in range(12):
        w = list(base)
        w[rng.randrange(len(w))] = "odd"
        rows.append((k, " ".join(w), None))
    # a piece of the text, in other words, inside a copy that has the piece in its own words too
    for k in (12, 13):
        rows.append((k, f"{' '.join(base)} {word()} {' '.join(base[400 + k : 413 + k])} {word()}", None))

    def seen(*dfs):
        for df in dfs:
            if "lens" in df.columns:
                sorted_on.extend(int((np.frombuffer(r["lens"], np.int64) - 49).sum()) for r in df.collect())
        dropped(*dfs)

    monkeypatch.setattr(op4_suffix.C, "dropped", seen)
    got = suffix_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = [(d, len(t), sum(m), bytes(b for b, x in zip(t, m) if not x)) for d, t, m in covered([r[:2] for r in rows], lambda t: (t or "").encode(), 50)]
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in got) == sorted(want)
    assert 0 < sum(sorted_on) < sum(r["n_bytes"] for r in got) / 10


def shingles(t, size):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    w = [x.translate(lower) for x in words_of(t)]
    return frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def linked(rows, size, num, den):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    return sets, list(groups.values())


def test_ngram_jaccard_join_has_all_links(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = [r[:2] for r in corpus(3)]
    for k in range(40):
        w = list(base)
        w[rng.randrange(len(w))] = f"odd{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000 + k, rows[-1 - k][1]) for k in range(3)]
    members, links = ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 9, 10)
    # a doc_id has several rows in places, so sets are told by id and size
    of_class = defaultdict(set)
    for r in members.collect():
        of_class[r["class_id"]].add((r["doc_id"], r["n_shingles"]))
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    sets = defaultdict(set)
    for d, t in rows:
        sets[shingles(t, 3)].add((d, len(shingles(t, 3))))
    want = {frozenset([frozenset(sets[x]), frozenset(sets[y])]) for x in sets for y in sets if x and y and x != y and 10 * len(x & y) >= 9 * len(x | y)}
    assert len(want) > 500
    assert {frozenset([frozenset(of_class[a]), frozenset(of_class[b])]) for a, b in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 8, 10)])
def test_ngram_jaccard_join(spark, size, num, den):
    rows = [r[:2] for r in corpus(3)]
    members, _ = ngram_jaccard_join(spark.createDataFrame(corpus(3), DOCS).repartition(3), size, num, den)
    sets, groups = linked(rows, size, num, den)
    want = []
    for g in groups:
        ids = [rows[a][0] for a in g if rows[a][0] is not None]
        want += [(rows[a][0], len(sets[a]), min(ids) if ids else None) for a in g]
    assert sorted(map(tuple, members.select("doc_id", "n_shingles", "component_id").collect()), key=key) == sorted(want, key=key)


def test_near_duplicate_filter_keeps_one_of_each_group(spark):
    rows = [r[:2] for r in corpus(3)]
    kept = near_duplicate_filter(spark.createDataFrame(corpus(3), DOCS), carry=["pack_id"]).collect()
    _, groups = linked(rows, 5, 8, 10)
    want = [min((rows[a][0] is None, rows[a][0] or 0) for a in g) for g in groups]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept) == sorted(want)
    assert {r["rest"] for r in kept} <= {'{"pack_id":"clash"}', "{}"}


def test_bpe_is_that_of_the_library(spark):
    from tokenizers import Tokenizer

    rows = corpus(4) + [(900, "a <|endoftext|> b", ""), (901, "naïve 中文 text\n\n  it's we'll", ""), (902, ("the same long sentence again and again, " * 40), ""), (903, ("the same long sentence again and again, " * 40), "")]
    t = Tokenizer.from_file(default_tokenizer())
    got = bpe_encode(spark.createDataFrame(rows, DOCS).repartition(4), default_tokenizer()).collect()
    want = []
    for d, text, _ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((d, ids, t.decode(ids, skip_special_tokens=False)))
    assert sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in got), key=key) == sorted(want, key=key)


def test_bpe_of_other_files_encodes_whole_texts(spark, tmp_path):
    from tokenizers import Tokenizer

    spec = json.loads(open(default_tokenizer(), encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    spec["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    rows = corpus(4) + [(902, ("The Same long sentence Again and again, " * 40), ""), (903, ("The Same long sentence Again and again, " * 40), "")]
    t = Tokenizer.from_file(str(path))
    got = bpe_encode(spark.createDataFrame(rows, DOCS).repartition(4), str(path)).collect()
    want = [(d, t.encode(text or "", add_special_tokens=False).ids) for d, text, _ in rows]
    assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == sorted(want, key=key)


def test_bpe_joins_that_do_not_agree_are_encoded_whole():
    from tidemark.llm import op2_bpe as B

    class One:
        """Tokens of two bytes from the start of a text: no encoding of a part agrees with that of the whole."""

        sizes = [1, 2]

        def encode(self, data):
            return [1] * (len(data) // 2) + [0] * (len(data) % 2)

        head, tail = B.Codec.head, B.Codec.tail

    text = " ".join(f"word{k * k} of a text that is long enough to be cut" for k in range(200)).encode()
    pack = C.Pack.__new__(C.Pack)
    import numpy as np

    pack.buf, pack.offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    chunks = B.Chunks(pack, True)
    codec = One()
    assert len(chunks.start) > 1
    assert B.joined(codec, chunks, [None] * len(chunks.distinct), text, pack.offsets) == [codec.encode(text)]


def top_k(rows, every, k=5):
    import numpy as np

    good = [(d, [int(np.floor(256 * float(np.float64(x)))) for x in v]) for d, v in rows if d is not None and v and None not in v and np.isfinite(np.array(v, float)).all()]
    asked = {}
    for d, v in good:
        if d % every == 0:
            asked[d] = min(asked.get(d, v), v)
    out = []
    for q, v in asked.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), d) for d, w in good if d != q and len(w) == len(v))[:k]
        out += [(q, n + 1, d, -s) for n, (s, d) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_top_k(spark, block, monkeypatch):
    from tidemark.llm import op7_topk

    monkeypatch.setattr(op7_topk, "BLOCK", block)
    monkeypatch.setattr(op7_topk, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)], "x") for k in range(120)]
    rows += [(200, [0.5] * 6, "x"), (201, [0.5] * 6, "x"), (250, None, "x"), (251, [0.1, None] * 3, "x"), (252, [float("nan")] * 6, "x"), (None, [0.9] * 6, "x")]
    rows += [(253, [float("inf")] * 6, "x"), (300, [0.25, 1.0], "x"), (301, [1.0, 0.5], "x"), (350, [0.0] * 6, "x"), (100, [0.7] * 6, "x"), (100, [0.7] * 6, "x"), (3, [0.5] * 6, "x"), (400, [], "x")]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string").repartition(3), every=50).collect()
    assert sorted(tuple(r) for r in got) == top_k([r[:2] for r in rows], 50)
    # components near 10**6, whose products pass 2**53
    rows = [(k, [rng.uniform(-1e6, 1e6) for _ in range(8)]) for k in range(60)]
    got = exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=20).collect()
    assert sorted(tuple(r) for r in got) == top_k(rows, 20)
    none = exact_top_k(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<double>"))
    assert none.count() == 0


def test_threshold_stops_early():
    """Few large components: the walk ends long before all vectors are scored, and ends with the right ones."""
    import numpy as np

    from tidemark.llm.op7_topk import threshold_top_k

    rng = np.random.default_rng(4)
    n, d, k = 4000, 16, 5
    vectors = np.floor(rng.pareto(1.5, (n, d)) * 10).astype(np.int64)
    queries = np.floor(rng.pareto(1.5, (10, d)) * 10).astype(np.int64)
    places, ids, own = np.argsort(vectors, axis=0, kind="stable").astype(np.int32), np.arange(n), np.full(10, -1)
    free = np.full(10, np.iinfo(np.int64).min)
    who, score, scored = threshold_top_k(queries, own, free, ids, vectors, places, k)
    all_scores = queries @ vectors.T
    for q in range(10):
        assert who[q].tolist() == np.lexsort((ids, -all_scores[q]))[:k].tolist()
    assert scored < n // 2
    # a bound from elsewhere that nothing here reaches ends it at once
    _, _, few = threshold_top_k(queries, own, all_scores.max(1) * 100, ids, vectors, places, k)
    assert few <= d


def test_url_filter(spark):
    rules = spark.createDataFrame([("block", "net/"), ("allow", "example.net/en/"), ("block", "a.org/x"), ("allow", "a.org/x")], "verdict string, rule string")
    urls = ["http://Example.NET/en/1?q", "https://m.example.net/de", "http://net", "x.net/a", None, "http://b.a.org/xy#f", "http://aa.org/xy", "http://", "://net/?"]
    got = url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in got] == [
        ("example.net", "/en/1", "example.net/en/", "allow"), ("m.example.net", "/de", "net/", "block"), ("net", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("b.a.org", "/xy", "a.org/x", "block"), ("aa.org", "/xy", None, "allow"), ("", "", None, "allow"), ("net", "/", "net/", "block"),
    ]


def test_url_filter_edge_cases(spark):
    rules = spark.createDataFrame([("block", "b.c/x/"), ("allow", None), (None, "c/"), ("block", "no slash"), ("block", "B.C/x/"), ("allow", "a.b.c/x/y")], "verdict string, rule string")
    deep = "http://" + "s." * 3000 + "b.c/x/" + "p" * 5000
    urls = [(1, deep), (1, deep), (None, "http://a.b.c/x/yz"), (2, "http://a.b.c/X/"), (3, ""), (4, "x://b.c?/x/")]
    pages = spark.createDataFrame([(k, u, "clash") for k, u in urls], "page_id long, url string, host string")
    got = url_filter(pages, rules).collect()
    assert sorted(((r["page_id"], r["rule"], r["verdict"]) for r in got), key=key) == sorted([(1, "b.c/x/", "block")] * 2 + [(None, "a.b.c/x/y", "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow")], key=key)
    none = spark.createDataFrame([], "verdict string, rule string")
    assert {r["verdict"] for r in url_filter(pages, none, default="block").collect()} == {"block"}
    assert url_filter(pages.limit(0), rules).count() == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert substring_dedup(docs).count() == suffix_dedup(docs).count() == bpe_encode(docs, default_tokenizer()).count() == 0
    assert ngram_jaccard_join(docs)[0].count() == 0
    assert exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_components(spark, parts):
    rng = random.Random(6)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(parts)).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}


def test_written_tables_can_be_dropped(spark):
    df = C.written(spark.range(5).select(F.col("id")))
    assert df.count() == 5
    C.dropped(df)


def swapped_words(bits=10):
    """Two words of 2**bits letters that swap a and b in Thue-Morse order: equal under any polynomial hash modulo 2**64."""
    odd = [k.bit_count() & 1 for k in range(1 << bits)]
    return "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)


def test_patterns_that_cancel_out_are_told_apart(spark):
    one, two = swapped_words()
    around = [f"w{k}" for k in range(60)]
    texts = [" ".join([*around[:30], x, *around[30:]]) for x in (one, two)]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").repartition(2)
    assert [r["n_removed"] for r in substring_dedup(docs, 50).collect()] == [0, 0]
    assert {r["doc_id"]: r["decoded"] for r in bpe_encode(docs, default_tokenizer()).collect()} == dict(enumerate(texts, 1))
    members, _ = ngram_jaccard_join(docs, 3, 99, 100)
    assert sorted(r["component_id"] for r in members.collect()) == [1, 2]
    # the same pattern over words, and over bytes of one text
    long = [" ".join(x) for x in swapped_words(11)]
    docs = spark.createDataFrame(list(enumerate(long, 1)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup(docs, 1100).collect()}
    assert got == {d: sum(m) for d, _, m in covered(list(enumerate(long, 1)), words_of, 1100)}


def test_hashes_tell_spans_by_their_values():
    import numpy as np

    rng = np.random.default_rng(3)
    values = C.mix(rng.integers(0, 3, 4000).astype(np.uint64))
    start = rng.integers(0, 3900, 3000)
    end = start + rng.integers(1, 90, 3000)
    for lane in (0, 1):
        of = dict(zip(C.span_hashes(values, start, end, lane).tolist(), (values[a:z].tobytes() for a, z in zip(start, end, strict=True)), strict=True))
        assert len(of) == len(set(of.values())) == len({values[a:z].tobytes() for a, z in zip(start, end, strict=True)})
        for size in (1, 2, 3, 7, 25):
            assert len(set(C.run_hashes(values, size, lane).tolist())) == len({values[a : a + size].tobytes() for a in range(4001 - size)})
    buf = rng.integers(97, 99, 3000).astype(np.uint8)
    for lane in (0, 1):
        for size in (1, 5, 8, 9, 24, 50):
            assert len(set(C.run_hashes(buf, size, lane).tolist())) == len({buf[a : a + size].tobytes() for a in range(3001 - size)})
    start = rng.integers(0, 2800, 2000)
    end = np.minimum(3000, start + rng.integers(0, 2000, 2000) // rng.integers(1, 2000, 2000))
    spans = [buf[a:z].tobytes() for a, z in zip(start, end, strict=True)]
    assert len(set(C.bytes_hashes(buf, start, end).tolist())) == len(set(spans)) == len(set(zip(C.bytes_hashes(buf, start, end).tolist(), spans, strict=True)))


def test_texts_longer_than_a_pack(spark):
    """Several packs, one text over the size of a pack, one very long word."""
    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(60))
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(330_000))
    rows = [(1, f"{long} {shared} end"), (2, f"start {shared} {'z' * 2_500_000}"), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect()}
    assert got == {1: (330_061, 0), 2: (62, 60), 3: (330_000, 330_000)}
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard_join(docs)[0].collect()} == {1: 1, 2: 2, 3: 1}
    sizes = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup(docs).collect()}
    assert sizes[1] == (len(rows[0][1]), 0) and sizes[3] == (len(long), len(long)) and len(shared) <= sizes[2][1] <= len(shared) + 4
    same = bpe_encode(docs, default_tokenizer()).collect()
    assert all(dict(rows)[r["doc_id"]] == r["decoded"] for r in same)
