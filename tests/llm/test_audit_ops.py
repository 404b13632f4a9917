"""Hard negatives, source divergence and personal data against brute force and their SQL."""

from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import op11_negatives
from tidemark.llm.op11_negatives import hard_negatives
from tidemark.llm.op12_divergence import best_terms, entries, source_divergence
from tidemark.llm.op13_pii import ADDED, BASE, IBAN_LENGTHS, KINDS, find_pii

VECTORS = "vec_id long, embedding array<float>, label int, score string, anchor int"


def mined(rows, k, positives, low, high, every, scale=256):
    """hard_negatives by comparing everything."""
    good = [(i, lb, np.floor(np.array(v, float) * scale).astype(int)) for i, v, lb in rows if i is not None and lb is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out, anchors = [], {}
    for i, lb, v in good:
        if i % every == 0 and (i not in anchors or (lb, v.tolist()) < anchors[i]):
            anchors[i] = (lb, v.tolist())
    for a, (lb, v) in anchors.items():
        scored = [(int(np.dot(v, w)), i, l2) for i, l2, w in good if i != a and len(w) == len(v)]
        order = sorted((s for s in scored if s[2] == lb), key=lambda s: (-s[0], s[1]))[:positives]
        for rank, (top, p, _) in enumerate(order, 1):
            some = sorted((s for s in scored if s[2] != lb and low * top <= high * s[0] <= high * top), key=lambda s: (-s[0], s[1]))[:k]
            out += [(a, p, r, s[1], top, s[0], rank) for r, s in enumerate(some, 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_negatives_as_brute_force(spark, k):
    rng = random.Random(k)
    rows = [(i, [np.float32(rng.gauss(0.4, 0.6)).item() for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(i, rows[40][1], 1) for i in range(400, 520)]  # equal vectors, with ties of every score
    rows += [(i, rows[40][1], 2) for i in range(520, 560)]  # also under another label
    rows += [(40, rows[41][1], 2), (40, rows[41][1], 2), (77, rows[77][1], rows[77][2])]  # repeated ids
    rows += [(1000, [1.0, 1.0], 0), (1001, [0.9, 1.0], 0), (1002, [0.8, 1.0], 1), (-20, rows[3][1], 0)]
    rows += [(600, None, 1), (601, [], 1), (602, [1.0] * 5 + [None], 1), (603, [1.0] * 5 + [float("nan")], 1), (604, [float("inf")] * 6, 1), (605, rows[5][1], None), (None, rows[6][1], 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], VECTORS).repartition(7)
    for low, high in ((80, 100), (1, 2), (100, 100)):
        got = hard_negatives(df, k=k, positives=4, low=low, high=high, every=20)
        want = mined(rows, k, 4, low, high, 20)
        assert want and sorted(tuple(r) for r in got.collect()) == want


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives(empty).columns == op11_negatives.OUT and not hard_negatives(empty).collect()
    alone = spark.createDataFrame([(0, [1.0], 1, None, None), (1, [1.0], 2, None, None)], VECTORS)
    assert not hard_negatives(alone).collect()  # no positive
    below = spark.createDataFrame([(0, [1.0], 1, None, None), (1, [-1.0], 1, None, None), (2, [-1.0], 2, None, None)], VECTORS)
    assert not hard_negatives(below).collect()  # a negative positive score has an empty window


def test_large_scores_take_more_digits(spark):
    rows = [(0, [3000.0], 0), (1, [2900.0], 0)] + [(i, [2899.0 - 0.37 * i], 1) for i in range(2, 300)]
    got = hard_negatives(spark.createDataFrame([(*r, None, None) for r in rows], VECTORS), k=200)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 200, 5, 80, 100, 100)


# --- source divergence ------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, source string, n int, term string"


def diverging(rows, least, top):
    """source_divergence by dictionaries."""
    words = [(x["lang"] or "", x["source"] or "", [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", x["text"] or "")]) for x in rows]
    docs, group, lang = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lg, src, ws in words:
        docs[lg].update(set(ws))
        group[lg, src].update(ws)
        lang[lg].update(ws)
    out = []
    for (lg, src), here in group.items():
        kept = [w for w, n in docs[lg].items() if n >= least]
        p = {s: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept} for (other, s), c in group.items() if other == lg}
        q = {w: 1 + 10**9 * (lang[lg][w] + 2) // (sum(lang[lg][x] for x in kept) + 2 * len(kept)) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        pairs = sorted(((-sum(f(p[src][w], p[s][w]) for w in kept), s.encode()) for s in p if s != src))
        terms = sorted((-f(p[src][w], q[w]), w.encode()) for w in kept if here[w] and p[src][w] > q[w])[:top]
        out += [(lg, src, part, name.decode(), -v, r) for part, some in (("pair", pairs), ("term", terms)) for r, (v, name) in enumerate(some, 1)]
    return sorted(out)


def _texts(rng, n):
    vocabulary = [f"{a}{b}" for a in ("la", "Él", "xin", "Ω", "ab'c", "mid-way", "two2") for b in ("", "é", "Z", "q", "😀")]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    rows = []
    for i in range(n):
        src = rng.choice(["a", "b", "Ä", None, "a"])
        own = [w * (3 if (k + len(src or "")) % 4 == 0 else 1) for k, w in enumerate(weights)]
        rows.append({"doc_id": i, "text": " ".join(rng.choices(vocabulary, own, k=rng.randrange(12))), "lang": rng.choice(["en", "de", None]), "source": src})
    return rows


@pytest.mark.parametrize("least, top", [(10, 10), (1, 3), (40, 2)])
def test_divergence_as_brute_force(spark, least, top):
    rng = random.Random(least)
    rows = _texts(rng, 300) + [{"doc_id": 900, "text": None, "lang": "en", "source": "empty"}, {"doc_id": 901, "text": "12 34", "lang": "xx", "source": "only"}, {"doc_id": 901, "text": "Alone", "lang": "yy", "source": "one"}, {"doc_id": 901, "text": "", "lang": "yy", "source": "two"}]
    rows += [rows[5]] * 30  # repeated rows
    df = spark.createDataFrame([(*r.values(), 1, "x") for r in rows], DOCS).repartition(5)
    assert sorted(tuple(r) for r in source_divergence(df, least, top).collect()) == diverging(rows, least, top)


def test_divergence_of_nothing(spark):
    assert not source_divergence(spark.createDataFrame([], DOCS)).collect()
    one = source_divergence(spark.createDataFrame([(1, "x" * 5_000_000 + " y", "en", "a", 1, None)], DOCS), least=1)
    assert not one.collect()  # one source is its lang: no pair, no term likelier than there


def test_search_leaves_buckets_unseen(spark):
    """Bounds keep most terms from being evaluated, and what is found is what all terms give."""
    rng = random.Random(3)
    words = [f"w{chr(97 + k // 676)}{chr(97 + k // 26 % 26)}{chr(97 + k % 26)}" for k in range(4000)]
    weights = [1 / (k + 10) for k in range(4000)]
    rows = [(i, " ".join(rng.choices(words, [w * (1 + 5 * ((k * 7 + i % 4) % 50 == 0)) for k, w in enumerate(weights)], k=400)), "en", f"s{i % 4}") for i in range(400)]
    groups, found = entries(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").select("lang", "source", "text"), 2)
    rounds: list = []
    best = best_terms(found, 10, rounds)
    every = found.filter("p > q").selectExpr("lang", "source", "term", "(p - q) * (p - q) div (p + q) AS value").collect()
    want = {s: [r["term"] for r in sorted((r for r in every if r["source"] == s), key=lambda r: (-r["value"], r["term"]))[:10]] for s in ("s0", "s1", "s2", "s3")}
    got = defaultdict(list)
    for r in best.orderBy("rank").collect():
        got[r["source"]].append(r["term"])
    assert got == want and sum(rounds) < found.count() / 10


# --- personal data ----------------------------------------------------------------------


def _valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def base_spans(text):
    out = [(m.start(), n, m.end(), k) for n, k in enumerate(BASE) for m in re.finditer(BASE[k], text or "") if _valid(k, m.group())]
    return [f"{k}:{a}:{z}" for a, _, z, k in sorted(out)]


def spans_of(spark, texts):
    rows = find_pii(spark.createDataFrame([(i, t, "x", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, spans string, score double")).collect()
    return [r["spans"] for r in sorted(rows, key=lambda r: r["doc_id"])]


def named(spans, kinds=KINDS):
    return [f"{s['kind']}:{s['start']}:{s['end']}" for s in spans if s["kind"] in kinds]


def test_base_spans_as_brute_force(spark):
    rng = random.Random(13)
    bits = ["a@b.c", "@", ".", "..", "1", "22", "255", "256", "1.2.3.4", "001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+", "+1 (017) 555-7713", " ", "-", "_", "é", "😀", "\n", "(", ")", "x", "Z%+-", "79927398713", "0" * 13, "a.b@c-d.e.f", "@x.y", "\x00", "\u00a0", "١٢", ""]
    texts = ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(3000)] + [None, "", "x", "a@b.c_d@e.f", "a@b.c@d.e", "+1 234 567 890 +49 (30) 1234567)", "1.2.3.4.5.6.7.8", "1.2.3.400"]
    for text, spans in zip(texts, spans_of(spark, texts), strict=True):
        assert named(spans, BASE) == base_spans(text), text
        assert all((text or "")[s["start"] : s["end"]] == s["text"] for s in spans)


def test_long_runs(spark):
    """Runs that exhaust a backtracking engine, and many matches in one text, take time in proportion."""
    texts = ["1" * 300_000, "a" * 300_000, "a." * 150_000, "1." * 150_000, "1 " * 150_000, "x@" + "y." * 150_000, "+1" + "(" * 300_000, "a@b.c " * 40_000, "é 4111111111111111, " * 20_000, "AT11" + "A1" * 100_000]
    began = time.monotonic()
    assert [len(s) for s in spans_of(spark, texts)] == [0, 0, 0, 37_500, 0, 1, 0, 40_000, 20_000, 0]
    assert time.monotonic() - began < 60


def iban(country, body):
    body = (body * 30)[: IBAN_LENGTHS[country] - 4]
    value = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - value % 97:02d}{body}"


def test_added_kinds(spark):
    good = [iban(c, "1X2B30") for c in ("GB", "FR")] + [iban(c, "370400440532013000") for c in ("DE", "ES", "NL")]
    texts = good + ["Konto: " + " ".join(good[2][i : i + 4] for i in range(0, 22, 4)) + " und mehr", good[2][:-1] + "9", "x" + good[2], good[2] + "1", good[2] + good[2]]
    found = [named(s, ADDED) for s in spans_of(spark, texts)]
    assert found[:5] == [[f"iban:0:{len(g)}"] for g in good]
    assert found[5] == ["iban:7:34"] and found[6:] == [[]] * 4
    texts = ["her SSN is 123-45-6789.", "part 123-45-6789", "the ssn of order 123-45-6789", "SSN 1123-45-6789", "Call (212) 555-0100 now", "call 212.555.0100", "212-555-0100", "recall 212-555-0100", "Teléfono 212 555 0100, Ende"]
    found = [named(s, ("ssn", "local_phone")) for s in spans_of(spark, texts)]
    assert found == [["ssn:11:22"], [], [], [], ["local_phone:5:19"], ["local_phone:5:17"], [], [], ["local_phone:9:21"]]


def test_scores_hear_context(spark):
    card, plain, ordered = spans_of(spark, ["my visa card 4111111111111111", "4111111111111111", "order 4111111111111111"])
    assert card[0]["score"] > plain[0]["score"] > ordered[0]["score"] and named(ordered) == ["card:6:22"]  # base kinds stay


def test_pii_rows(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "a@b.c"), (None, "a@b.c"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, len(r["spans"])) for r in find_pii(df).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0)]
    assert not find_pii(df.limit(0)).collect()
    plan = find_pii(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
