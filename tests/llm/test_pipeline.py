"""The pipeline, by stage and end to end, against brute force or planted cases."""

from __future__ import annotations

import random
import re

import corpus_pipeline as P
import pytest
from tidemark.llm.op2_bpe import default_tokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, kept string"


def prose(rng, n):
    """Sentences of invented words."""
    words = [rng.choice(WORDS) for _ in range(n)]
    for k in range(0, n, 9):
        words[k] = words[k].capitalize()
        if k:
            words[k - 1] += "."
    return " ".join(words) + "."


_RNG = random.Random(20)
WORDS = ["".join(_RNG.choice(["an", "er", "ti", "on", "re", "wh", "ou", "st", "ed"]) for _ in range(_RNG.randint(1, 4))) for _ in range(2000)]
ITEMS = [(k, prose(_RNG, 30)) for k in range(8)]


def corpus():
    rng = random.Random(21)
    passage = prose(rng, 70)
    texts = {d: prose(rng, rng.randint(60, 160)) for d in range(60)}
    for d in (60, 61):
        texts[d] = texts[d - 60]  # exact copies
    for d in (62, 63):
        w = texts[d - 60].split()
        w[10] = "odd"
        texts[d] = " ".join(w)  # near copies
    for d in range(64, 70):
        texts[d] = f"{prose(rng, 40)} {passage} {prose(rng, 30)}"
    for d in range(70, 74):
        texts[d] = f"{prose(rng, 40)} {ITEMS[d - 70][1]} {prose(rng, 30)}"
    for d in range(74, 80):
        texts[d] = " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in prose(rng, 80).split())
    rows = [(d, t, "en", f"s{d % 3}", len(t), "clash", "clash") for d, t in texts.items()]
    return [*rows, (80, None, None, None, None, None, None), (81, "", "en", None, 0, None, None), (81, "", "en", None, 0, None, None), (None, prose(rng, 50), None, "s", None, None, None), rows[5]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(corpus(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{path}/none.parquet")
    return path


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def ids(found):
    return sorted(d for d, _ in found if d is not None)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    given = rows(docs)
    kept = rows(P.quality(spark, docs, folder))
    assert not set(ids(kept)) & set(range(74, 80)) and set(range(74)) <= set(ids(kept)) and set(kept) <= set(given)

    near = P.near_duplicates(spark, docs, folder)
    assert near.columns == P.COLUMNS
    found = rows(near)
    sets = {}
    for d, t in found:
        w = (t or "").lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert ids(found) == sorted([*range(60), *range(64, 82), 81]) and any(d is None for d, _ in found)
    assert all(10 * len(a & b) < 8 * len(a | b) for d, a in sets.items() for e, b in sets.items() if d is not e and a and b)

    cut = rows(P.repeated_passages(spark, docs, folder))
    known, want = set(), {}
    by_id = {}
    for d, t in given:
        by_id.setdefault(d, []).append(t)
    for d in sorted(by_id, key=lambda d: (d is None, d or 0)):
        new = set()
        for t in by_id[d]:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            gone = [False] * len(w)
            for p in range(len(w) - 49):
                run = tuple(w[p : p + 50])
                new.add(run)
                if run in known:
                    gone[p : p + 50] = [True] * 50
            left = " ".join(x for x, g in zip(w, gone) if not g)
            if left or not any(gone):
                want.setdefault((d, None if t is None else left), []).append(1)
        known |= new
    assert sorted(map(repr, cut)) == sorted(repr(k) for k, n in want.items() for _ in n)

    clean = rows(P.benchmark_leaks(spark, docs, folder))
    assert sorted(map(repr, clean)) == sorted(repr(r) for r in given if r[0] not in range(70, 74))

    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    got = P.encoded(spark, docs, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in got) == sorted((d is None, d or 0, t.encode(x or "", add_special_tokens=False).ids) for d, x in given)
    assert all(r["exact"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_of_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/none.parquet")
    for name, stage in P.STAGES:
        found = stage(spark, none, folder)
        assert found.count() == 0
        assert name == "encoded" or found.columns == P.COLUMNS


def test_run(spark, folder):
    """Each stage works on what the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in P.STAGES:
        docs = P.C.written(stage(spark, docs, folder))
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in docs.collect())
    got = P.run(spark, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in got) == want
    left = {r["doc_id"] for r in got}
    assert {*range(60), *range(64, 70)} <= left and not left & {60, 61, 62, 63, *range(70, 80)}
