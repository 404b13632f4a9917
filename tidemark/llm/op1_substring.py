"""Operator 1: substring dedup on words, by fixed-block anchors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import repeats as R

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<int>, kept string, rest string"


def words_joined(tokens: R.Tokens, keep: np.ndarray):
    """For each document the kept words, joined by one space: bytes and offsets."""
    starts, ends = tokens.starts[keep], tokens.ends[keep]
    count = np.add.reduceat(np.append(keep, False).astype(np.int64), np.minimum(tokens.first[:-1], len(keep))) if len(tokens.first) > 1 else np.zeros(0, np.int64)
    count[np.diff(tokens.first) == 0] = 0
    after = np.cumsum(count)
    size = ends - starts + 1
    size[after[count > 0] - 1] -= 1  # no space after a document's last word
    to = np.cumsum(size)
    total = int(to[-1]) if len(to) else 0
    source = np.repeat(starts - (to - size), size) + np.arange(total)
    out = tokens.pack.buf[np.minimum(source, len(tokens.pack.buf) - 1)] if total else np.zeros(0, np.uint8)
    spaced = size > ends - starts
    out[to[spaced] - 1] = 32
    return out, np.concatenate([[0], np.concatenate([[0], to])[after]])


def substring_dedup(docs: DataFrame, window: int = 50, text: str = "text", key: str = "doc_id", carry: list[str] = ()) -> DataFrame:
    """Remove each word covered by a window that also starts in a document with a smaller id.

    Words are runs of bytes outside [\\x20\\x09-\\x0D], unchanged. A reference block of
    window // 2 words stands at every multiple of its length; every window of words holds a
    whole one, wherever it starts. The index has the blocks' digests; every rolling window of a
    block's length probes it, and hits are extended on the words to both sides, to maximal
    exact repeats (see repeats).

    Returns doc_id, n_words, n_removed, spans (start and end of each removed run, in words),
    kept (remaining words joined by one space) and rest (JSON of the carried columns).
    A null text gives no words and a null kept; an empty one gives an empty kept. Rows of one
    doc_id are judged alone and never remove one another's words; a null doc_id ranks last.
    Other columns play no part, whatever their names. An empty table gives no rows.
    """
    block = (window + 1) // 2
    plan = R.Plan(window, block, block, words=True, aligned=True)

    def emit(tokens: R.Tokens, gone: np.ndarray):
        data, offsets = words_joined(tokens, ~gone)
        starts, ends = R.runs(gone, tokens.first)
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[tokens.first])
        p = tokens.pack
        return C.batch_of(SCHEMA, [p.id_column(), np.diff(tokens.first), removed, R.span_lists(starts, ends, tokens.first), C.strings(data, offsets, nulls=p.nulls), p.rest()])

    return R.remove_repeats(C.packed(docs, text, key, carry), plan, SCHEMA, emit)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM words WHERE len(w) >= 50
), hashed AS (
  SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM windows
), firsts AS (
  SELECT h, min(doc_id) AS d FROM hashed GROUP BY h
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS q FROM hashed JOIN firsts USING (h) WHERE d < doc_id
), lists AS (
  SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id
), each AS (
  SELECT doc_id, w, coalesce(qs, []) AS qs FROM words LEFT JOIN lists USING (doc_id)
), kept AS (
  SELECT doc_id, w, qs, list_filter(w, lambda x, i: NOT list_contains(qs, i)) AS k FROM each
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(qs)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM kept
"""
