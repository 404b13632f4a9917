"""Operators that are learned or retrieve: held-out accuracy, planted cases, defined edge cases."""

from __future__ import annotations

import json
import random

import numpy as np
from tidemark.llm.automaton import NEAR, NONE, STEM, WORD, Automaton
from tidemark.llm.op5_quality import quality_filter, quality_scores
from tidemark.llm.op6_chat import format_chat
from tidemark.llm.op8_toxicity import toxicity
from tidemark.llm.op10_decontaminate import common_in_order, decontaminate, leaks

DOCS = "doc_id long, text string, score string"


def prose(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(n)).capitalize() + "."


def vocabulary(rng, n=400):
    return ["".join(rng.choice(["an", "er", "ti", "on", "the", "re", "wh", "ou", "st", "ed"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def match(a, *words):
    data = b"".join(words)
    ends = np.cumsum([len(w) for w in words])
    return a.match(np.frombuffer(data, np.uint8), ends - np.array([len(w) for w in words]), ends).tolist()


def test_automaton_against_edit_distance():
    terms, rng = [b"idiot", b"trash", b"worthless"], random.Random(1)
    a = Automaton(terms, [b"stupi"])

    def near(w, t):
        """Edits, a swap of neighbours being one."""
        d = {(i, 0): i for i in range(len(w) + 1)} | {(0, j): j for j in range(len(t) + 1)}
        for i in range(1, len(w) + 1):
            for j in range(1, len(t) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (w[i - 1] != t[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
                if i > 1 and j > 1 and w[i - 2 : i] == t[j - 2 : j][::-1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(w), len(t)]

    words = [*terms, b"idot", b"idiott", b"idi0t", b"stupid", b"stupidly", b"stup", b"x", b"trsh", b"treasure", b"idoit", b"trahs", b"worhtless", b"stuip", b"stuipdly"]
    for _ in range(300):
        w = bytearray(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(1, len(w))] = rng.choice(b"abcdio")
        k = rng.randrange(1, len(w) - 1)
        w[k : k + 2] = w[k : k + 2][::-1] if rng.random() < 0.3 else w[k : k + 2]
        words.append(bytes(w))
    assert match(a, b"idoit", b"trahs", b"worhtless", b"stuip") == [NEAR] * 4
    for w, got in zip(words, match(a, *words), strict=True):
        if w in terms:
            assert got == WORD
        elif w.startswith(b"stupi"):
            assert got == STEM
        elif got == NEAR:
            assert min(near(w, t) for t in terms) == 1 or any(near(w[:k], b"stupi") <= 1 for k in range(len(w) + 1))
        else:
            assert got == NONE and not any(near(w, t) <= 1 and w[:1] == t[:1] for t in terms)


def test_every_telling_term_is_learned(spark):
    """Two hundred terms, of which each marks a few rows, and no word that only happens to be in toxic ones."""
    rng = random.Random(15)
    words = vocabulary(rng)
    terms = ["zq" + "".join(rng.choice("bdfgk") + rng.choice("aeiou") for _ in range(4)) for _ in range(200)]
    docs = []
    for d in range(6000):
        t = prose(rng, rng.randint(10, 40), words).split()
        if d % 4 == 0:
            t.insert(rng.randrange(len(t)), terms[d // 4 % 200])
        docs.append((d, " ".join(t), None))
    docs += [docs[0]] * 3
    labels = spark.createDataFrame([(d, int(d % 4 == 0)) for d in range(6000)], "doc_id long, toxic int")
    got = toxicity(spark.createDataFrame(docs, DOCS), labels).collect()
    assert len(got) == len(docs)
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in got) >= 0.99 * len(got)


def test_small_shares_are_drawn(spark):
    from tidemark.llm import common as C

    ids = spark.range(200_000)
    assert ids.filter(C.drawn("id", 1.0)).count() == 200_000 and ids.filter(C.drawn("id", 0.0)).count() == 0
    assert 10 <= ids.filter(C.drawn("id", 1e-4)).count() <= 40
    bound = -(1 << 63) + int(1e-12 * 2.0**64)
    assert bound > -(1 << 63)  # one in 10**12 is still some


def test_toxicity_holds_out(spark):
    rng = random.Random(2)
    words = vocabulary(rng)
    docs, labels = [], []
    for d in range(600):
        t = prose(rng, rng.randint(10, 60), words).split()
        toxic = d % 4 == 0
        if toxic:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(["gormless", "blaggard", "nitwit"]))
        docs.append((d, " ".join(t), "x"))
        labels.append((d, int(toxic)))
    docs += [(1000, "Therein whon you gormles, er blagard thed.", None), (1001, 'He said the word "nitwit" was a term.', None), (1002, "", None), (1003, None, None), (None, "ther", None)]
    labels += [(None, 1), (5, None)]
    frame = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity(spark.createDataFrame(docs, DOCS), frame.filter("doc_id % 5 <> 0")).collect()
    assert len(got) == len(docs)
    by = {r["doc_id"]: r for r in got}
    held = [d for d in range(600) if d % 5 == 0]
    assert sum((by[d]["score"] >= 0.5) == (d % 4 == 0) for d in held) >= 0.97 * len(held)
    assert by[1000]["matches"] == 2 and by[1001]["quoted"] == 1
    assert by[1002]["score"] == by[1003]["score"] < 0.5
    none = toxicity(spark.createDataFrame([(1, "a b c", None)], DOCS), spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert none[0]["score"] < 0.5
    assert toxicity(spark.createDataFrame([], DOCS), frame).count() == 0


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(3)
    words = vocabulary(rng)
    docs = []
    for d in range(500):
        t = prose(rng, rng.randint(3, 80), words)
        if d % 5 == 1:
            t = " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in t.split())
        elif d % 5 == 2 and len(t) > 60:
            t = " ".join(w.upper() + "!!" for w in t.split())
        elif d % 5 == 3 and len(t) > 60:
            t = " | ".join(t.split())
        docs.append((d, t, None))
    docs += [(900, "", None), (901, None, None), (902, " \n ", None), (None, docs[0][1], None)]
    table = spark.createDataFrame(docs, DOCS)
    by = {r["doc_id"]: r["score"] for r in quality_scores(table).collect()}
    assert all(by[d] >= 0.5 for d in range(500) if d % 5 in (0, 4))
    bad = [d for d in range(500) if d % 5 == 1 or (d % 5 in (2, 3) and len(docs[d][1]) > 120)]
    assert sum(by[d] < 0.5 for d in bad) >= 0.95 * len(bad)
    kept = quality_filter(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {d for d, s in by.items() if s >= 0.5}
    assert quality_filter(spark.createDataFrame([], DOCS)).count() == 0


def test_leaks_finds_copies_and_paraphrases(spark):
    rng = random.Random(4)
    words = vocabulary(rng, 4000)
    items = [(k, prose(rng, rng.randint(18, 50), words)) for k in range(30)]
    docs, want = [], set()
    for d in range(300):
        t = prose(rng, rng.randint(20, 200), words)
        if d % 10 == 0:
            k = rng.randrange(30)
            item = items[k][1].split()
            if d % 20 == 0:  # a paraphrase that keeps the answer
                for j in rng.sample(range(len(item) - 8), len(item) // 5):
                    item[j] = "otherwise"
            t = f"{t} {' '.join(item)} {t[:50]}"
            want.add((d, k))
        docs.append((d, t, "x"))
    docs += [(900, None, None), (901, "", None), (None, items[0][1], None)]
    table = spark.createDataFrame(docs, DOCS)
    bench = spark.createDataFrame([*items, (98, None), (99, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks(table, bench).collect()}
    assert got == want | {(None, 0)}
    left = decontaminate(table, bench)
    assert left.columns == table.columns and left.count() == len(docs) - len({d for d, _ in want})
    assert leaks(table, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert leaks(spark.createDataFrame([], DOCS), bench).count() == 0


def test_leaks_finds_an_item_in_a_third_of_the_documents(spark):
    rng = random.Random(7)
    words = vocabulary(rng, 4000)
    items = [(k, prose(rng, rng.randint(18, 40), words)) for k in range(30)]
    docs, want = [], set()
    for d in range(300):
        t = prose(rng, rng.randint(20, 200), words)
        for k in [0] * (d % 3 == 0) + [1 + d % 29] * (d % 15 == 0):
            t = f"{t} {items[k][1]} {prose(rng, rng.randint(1, 40), words)}"
            want.add((d, k))
        docs.append((d, t, "x"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(spark.createDataFrame(docs, DOCS), bench).collect()} == want


def test_leaks_finds_long_items(spark):
    rng = random.Random(8)
    words = vocabulary(rng, 4000)
    items = [(k, prose(rng, (400, 1000)[k % 2], words)) for k in range(10)]
    docs = [(d, f"{prose(rng, rng.randint(20, 200), words)} {items[d % 10][1]} {prose(rng, 30, words)}" if d % 3 == 0 else prose(rng, 300, words), "x") for d in range(90)]
    got = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d % 10) for d in range(0, 90, 3)}


def test_leaks_recall_against_brute_force(spark):
    """Items of 10 to 300 words, of common words only or not, copied with changes of all degrees: every window of every document, all items."""
    rng = random.Random(12)
    words, common = vocabulary(rng, 2000), [f"c{k}" for k in range(30)]
    items = [(k, " ".join(rng.choice(common if k % 4 == 0 else words) for _ in range((10, 25, 60, 300)[k % 3 if k % 10 else 3]))) for k in range(40)]
    docs = []
    for d in range(120):
        t = [rng.choice(words + common * 20) for _ in range(rng.randint(20, 150))]
        if d % 2:
            item = items[rng.randrange(40)][1].split()
            change = rng.choice([0, 0.1, 0.25, 0.4, 0.6])
            t[10:10] = [w if rng.random() > change else rng.choice(words) for w in item]
        docs.append((d, " ".join(t), "x"))
    code: dict = {}
    number = lambda t: np.array([code.setdefault(w, len(code)) for w in t.split()])
    want = set()
    for k, item in items:
        item = number(item)
        for d, t, _ in docs:
            t = number(t)
            span = len(item) * 3 // 2
            for s in range(0, max(1, len(t) - span + 1), 1 if len(item) < 100 else 10):
                part = t[s : s + span]
                if np.isin(part, item).sum() < 0.5 * len(item):
                    continue
                share = common_in_order(item, part) / len(item)
                if share >= 0.7 or share >= 0.5 and common_in_order(item[-8:], part) >= 6:
                    want.add((d, k))
                    break
    found = leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(want) > 30 and len(got & want) >= 0.95 * len(want)
    assert not {(r["doc_id"], r["item_id"]) for r in found if r["share"] < 0.5}


def test_leaks_edge_cases(spark):
    """Repeated rows and items, ties, clashing names, words that differ by swapped letters only."""
    odd = [k.bit_count() & 1 for k in range(1024)]
    one, two = "".join("ab"[x] for x in odd), "".join("ba"[x] for x in odd)
    items = [(1, f"{one} alpha {one} beta {one} gamma delta"), (2, "one two three four five six seven"), (2, "one two three four five six seven")]
    docs = [(1, f"{two} uno {two} dos {two} tres cuatro", "x"), (2, "so: one two three four five six seven.", "x"), (2, "so: one two three four five six seven.", "x"), (3, items[0][1], None)]
    table = spark.createDataFrame(docs, "doc_id long, text string, _leak string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks(table, bench).collect())
    assert got == [(2, 2)] * 4 + [(3, 1)]
    left = decontaminate(table, bench)
    assert left.columns == table.columns and [r["doc_id"] for r in left.collect()] == [1]


def test_common_in_order():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert common_in_order(np.array(a), np.array(b)) == t[-1][-1]


def test_chat_links_orders_and_validates(spark):
    call = lambda *calls: json.dumps({"tool_calls": [dict(zip(("id", "name", "arguments", "depends_on"), c, strict=True)) for c in calls]})
    result = lambda k, c: json.dumps({"tool_call_id": k, "content": c})
    rows = [
        (1, 0, "user", "hi é \n\""), (1, 1, "tool", result("a", "5")), (1, 2, "assistant", call(("a", "add", '{"y":2,"x":1}', []))), (1, 3, "assistant", call(("b", "add", '{"x":"no"}', ["a"]))), (1, 4, "tool", result("z", "?")),
        (2, 0, "assistant", call(("a", "add", "{}", ["b"]))), (2, 1, "assistant", call(("b", "add", "{}", ["a"]))), (2, 2, "tool", result("a", "1")), (2, 3, "tool", result("b", "1")),
        (None, 1, None, None), (3, 0, "assistant", '{"tool_calls": 3'), (3, 0, "assistant", '{"tool_calls": 3'),
    ]
    schema = {"add": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer"}, "y": {"type": "integer"}}}}
    got = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schema).collect()
    assert len(got) == len(rows)
    one = sorted((r for r in got if r["conv_id"] == 1), key=lambda r: (r["place"], r["level"], r["turn"]))
    assert [r["turn"] for r in one] == [0, 2, 1, 3, 4]
    assert one[0]["message"] == '{"content":"hi é \\n\\"","role":"user"}'
    assert '"arguments":{"x":1,"y":2}' in one[1]["message"] and one[1]["linked"] and one[1]["problems"] is None
    assert one[3]["problems"].startswith("b: no result") and "$.y: missing" in one[3]["problems"]
    assert one[4]["problems"] == "z: no call"
    assert all("cyclic" in r["problems"] for r in got if r["conv_id"] == 2)
    assert format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_orders_long_chains(spark):
    call = lambda k: json.dumps({"tool_calls": [{"id": f"c{k}", "name": "f", "arguments": "{}", "depends_on": [f"c{k - 1}"] if k else []}]})
    result = lambda k: json.dumps({"tool_call_id": f"c{k}", "content": "1"})
    chain = [m for k in range(30) for m in (("assistant", call(k)), ("tool", result(k)))]
    rows = [(1, 100 - j, *m) for j, m in enumerate(chain)]  # logged in reverse
    rows += [(2, 100 + j if j else 400, *m) for j, m in enumerate(chain)]  # the first call is logged late
    rows += [(3, 0, "assistant", call(1)), (3, 1, "tool", result(1)), (3, 2, "assistant", call(0).replace("[]", '["c1"]')), (3, 3, "tool", result(0))]
    got = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    for conv, want in ((1, [100 - j for j in range(60)]), (2, [400, *range(101, 160)])):
        mine = [r for r in got if r["conv_id"] == conv]
        assert [r["turn"] for r in sorted(mine, key=lambda r: (r["place"], r["level"], r["turn"]))] == want
        assert all(r["problems"] is None for r in mine)
    assert all(r["problems"] == "cyclic dependencies" and r["place"] == r["turn"] for r in got if r["conv_id"] == 3)


def test_chat_order_crosses_blocks_of_turns(spark, monkeypatch):
    from tidemark.llm import op6_chat

    monkeypatch.setattr(op6_chat, "TURNS", 7)
    test_chat_orders_long_chains(spark)


def test_chat_order_against_brute_force(spark):
    rng = random.Random(14)
    rows, want = [], {}
    for conv in range(12):
        n = rng.randint(2, 25)
        turns = rng.sample(range(-50, 50), 2 * n)
        needs = {k: rng.sample(range(k), min(k, rng.randint(0, 2))) for k in range(n)}
        if conv % 4 == 3:
            needs[0] = [n - 1]
            needs[n - 1] = [*needs[n - 1], 0]
        pred = {}
        for k in range(n):
            call = json.dumps({"tool_calls": [{"id": f"c{k}", "name": "f", "arguments": "{}", "depends_on": [f"c{j}" for j in needs[k]]}]})
            rows += [(conv, turns[2 * k], "assistant", call), (conv, turns[2 * k + 1], "tool", json.dumps({"tool_call_id": f"c{k}", "content": "1"}))]
            pred[turns[2 * k + 1]] = [turns[2 * k]]
            pred[turns[2 * k]] = [turns[2 * j + 1] for j in needs[k]]

        def at(t, pred=pred):
            best = (t, 0)
            for u in pred[t]:
                place, level = at(u)
                best = max(best, (place, level + 1))
            return best

        for t in turns:
            want[conv, t] = (t, 0) if conv % 4 == 3 else at(t)
    rows += rows[:3]
    got = format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(rows)
    assert {(r["conv_id"], r["turn"]): (r["place"], r["level"]) for r in got if r["conv_id"]} == {k: v for k, v in want.items() if k[0]}
    assert all(("cyclic dependencies" in (r["problems"] or "")) == (r["conv_id"] % 4 == 3) for r in got)
