"""Exact removal of token windows that also start in a document with a smaller id.

Four passes over packs of documents.

1. Addresses. Either every rolling block of tokens probes an index of the blocks that stand at
   multiples of their length (``aligned``), or the gram of least hash in a window's first
   ``block`` tokens stands for it. What is in one document only is settled.
2. Contexts. Windows that share an address, the one of least hash among their hits, make a run.
   The hit is extended to both sides as far as the windows of its run reach, and the whole
   stretch is compared. Where an equal one stands in a smaller document, all of its windows
   do. Where all occurrences of an address have one context, nothing more is needed.
3. Windows. For the first document of each context of an address with several contexts,
   every window is compared at full length.
4. The answers mark the windows; what they cover together are the maximal repeats, and it goes.

Exchanges send each pack's distinct keys once (see common.entries): a passage in a third
of all documents is one entry per pack, and no pair of documents is ever formed. Pass 1 may
take different tokens for equal, which costs work only. Contexts and windows are told apart by
128 bits, mixed at each joint of tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

_LOW, _NONE = np.uint64(0xFFFFFFFF), np.uint64(0xFFFFFFFFFFFFFFFF)
#: Answers of pass 1.
SHARED, HIT = 1, 2
#: Answers of pass 2.
ALONE, COVERED, MIXED = 0, 1, 2


@dataclass(frozen=True)
class Plan:
    """window: tokens of a repeat. block: tokens of an indexed block, or in which the anchor is sought. gram: the anchor's length.

    words: tokens are words, else bytes. aligned: blocks at multiples of ``block`` in each
    document are indexed, and all rolling ones probe.
    """

    window: int
    block: int
    gram: int
    words: bool
    aligned: bool

    def __post_init__(self):
        if not 1 <= self.gram <= self.block <= self.window:
            raise ValueError("1 <= gram <= block <= window is needed")
        if self.aligned and self.window < 2 * self.block - 1:
            raise ValueError("a window must hold a whole aligned block wherever it starts")

    def keys_per_byte(self) -> float:
        return 1 / 5 if self.aligned else 2 / (self.block - self.gram + 2) / (5 if self.words else 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


class Tokens:
    """Tokens of a pack, and the windows in which a repeat can lie."""

    def __init__(self, pack: C.Pack, plan: Plan):
        self.pack, self.plan = pack, plan
        if plan.words:
            self.starts, self.ends, self.first = C.word_bounds(pack.buf, pack.offsets)
            self.values = C.bytes_hashes(pack.buf, self.starts, self.ends)
        else:
            self.first, self.values = pack.offsets, pack.buf
        self.n = len(self.values)
        counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.left = self.first[1:][self.doc] - np.arange(self.n)
        self.long = counts[self.doc] >= plan.window

    def spans(self, start: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
        return C.span_hashes(self.values, start, end, lane) if self.plan.words else C.bytes_hashes(self.values, start, end, lane)

    def probes(self, kept_bits: int = 64) -> None:
        """Keys of pass 1 with their documents: aligned and rolling blocks, or the distinct anchors of all blocks."""
        k, b = self.plan.gram, self.plan.block
        at = np.flatnonzero(self.long & (self.left >= b))
        if self.plan.aligned:
            self.hash = C.run_hashes(self.values, b)
            self.key_at = at
            self.key_aligned = (at - self.first[self.doc[at]]) % b == 0
        else:
            self.hash = C.run_hashes(self.values, k)
            least = (self.hash & ~_LOW) | np.arange(len(self.hash), dtype=np.uint64)
            self.address = (_least(least, b - k + 1)[at] & _LOW).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[len(at) > 0], self.address[1:] != self.address[:-1]])) if len(at) else at
            self.at, self.key_at = at, self.address[cut]
            self.key_aligned = np.ones(len(cut), bool)
        self.key = self.hash[self.key_at] & ~np.uint64((1 << (64 - kept_bits)) - 1)

    def first_pass(self):
        """Sorted distinct keys; whether several documents have each; whether an indexed block has it."""
        order = np.argsort(self.key)
        key, doc = self.key[order], self.doc[self.key_at[order]]
        cut = np.flatnonzero(C.group_starts(key))
        self.key_group = np.empty(len(key), np.int64)
        if not len(key):
            return key, np.zeros(0, np.uint8)
        self.key_group[order] = np.cumsum(C.group_starts(key)) - 1
        several = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
        aligned = np.logical_or.reduceat(self.key_aligned[order], cut)
        return key[cut], several * np.uint8(SHARED) + aligned * np.uint8(HIT)

    def second_pass(self, first: np.ndarray):
        """Entries of the runs that can repeat: address key, context, least id."""
        n, b = self.plan.window, self.plan.block
        hit = (first[self.key_group] & HIT) > 0 if len(self.key_at) else np.zeros(0, bool)
        # the address of each window that has one
        start = np.flatnonzero(self.long & (self.left >= n))
        if self.plan.aligned:
            least = np.full(len(self.hash), _NONE)
            at = self.key_at[hit]
            least[at] = (self.hash[at] & ~_LOW) | at.astype(np.uint64)
            found = _least(least, n - b + 1)[start] if len(start) else least[:0]
            start, address = start[found != _NONE], (found[found != _NONE] & _LOW).astype(np.int64)
        else:
            live = np.zeros(len(self.hash), bool)
            live[self.key_at[hit]] = True
            address = self.address[np.searchsorted(self.at, start)]
            start, address = start[live[address]], address[live[address]]
        cut = np.concatenate([[True], (address[1:] != address[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else np.zeros(0, bool)
        lead = np.flatnonzero(cut)
        self.lo, self.hi = start[lead], start[np.append(lead[1:], len(start)) - 1] if len(start) else start
        at = address[lead]
        key = self.hash[at]
        shape = ((at - self.lo).astype(np.uint64) << np.uint64(32)) | (self.hi - self.lo).astype(np.uint64)
        context, check = (C.joined(self.spans(self.lo, self.hi + n, lane), shape) for lane in (0, 1))
        ids = self.pack.ids[self.doc[self.lo]]
        order = np.lexsort((ids, check, context, key))
        cut = C.group_starts(key[order], context[order], check[order])
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(cut) - 1
        self.lead, self.run_id = order[cut] if len(key) else order, ids
        lead = self.lead
        return key[lead], context[lead], check[lead], ids[lead]

    def third_pass(self, second: np.ndarray):
        """Entries of the windows of first documents of mixed contexts: window key, least id."""
        mixed = np.flatnonzero(second == MIXED)
        run = self.lead[mixed] if len(mixed) else np.zeros(0, np.int64)
        count = self.hi[run] - self.lo[run] + 1
        first = np.cumsum(count) - count
        at = C.ranges(self.lo[run], count)
        key, check = (self.spans(at, at + self.plan.window, lane) for lane in (0, 1))
        ids = np.repeat(self.run_id[run], count)
        order = np.lexsort((ids, check, key))
        cut = C.group_starts(key[order], check[order])
        group = np.empty(len(key), np.int64)
        group[order] = np.cumsum(cut) - 1
        lead = order[cut] if len(key) else order
        self.mixed_first = np.full(len(second), -1)
        self.mixed_first[mixed] = first
        self.window_group, self.window_id, self.least_id = group, ids, ids[lead]
        return key[lead], check[lead], ids[lead]

    def removed(self, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        """Mask of the tokens that a repeated window covers."""
        cover = np.zeros(self.n + 1, np.int64)
        group = self.group
        whole = (second[group] == COVERED) | (self.run_id > self.run_id[self.lead][group]) if len(group) else np.zeros(0, bool)
        run = np.flatnonzero(whole)
        np.add.at(cover, self.lo[run], 1)
        np.add.at(cover, self.hi[run] + self.plan.window, -1)
        run = np.flatnonzero(~whole & (second[group] == MIXED)) if len(group) else np.zeros(0, np.int64)
        if len(run):
            gone = (self.window_id > self.least_id[self.window_group]) | (third[self.window_group] > 0)
            count = self.hi[run] - self.lo[run] + 1
            at = C.ranges(self.lo[run], count)[gone[C.ranges(self.mixed_first[group[run]], count)]]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + self.plan.window, -1)
        return np.cumsum(cover[:-1]) > 0


def _decide_anchor(keys, who, extras):
    """Bits for keys that several documents have."""
    order = np.argsort(keys, kind="stable")
    cut = C.group_starts(keys[order])
    at, group = np.flatnonzero(cut), np.cumsum(cut) - 1
    flags = np.bitwise_or.reduceat(extras[0][order], at)
    count = np.diff(np.concatenate([at, [len(keys)]]))
    shared = (count > 1) | ((flags & SHARED) > 0)
    out = np.empty(len(keys), np.uint8)
    out[order] = (shared * np.uint8(SHARED) + (shared & ((flags & HIT) > 0)) * np.uint8(HIT))[group]
    return out


def _decide_context(keys, who, extras):
    context, check, ids = extras
    order = np.lexsort((ids, check, context, keys))
    k, i = keys[order], ids[order]
    each, whole = C.group_starts(k, context[order], check[order]), C.group_starts(k)
    contexts = np.add.reduceat(each.astype(np.int64), np.flatnonzero(whole))[np.cumsum(whole) - 1]
    least = i[each][np.cumsum(each) - 1]
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(least < i, COVERED, np.where(contexts > 1, MIXED, ALONE))
    return out


def decide_window(keys, who, extras):
    check, ids = extras
    order = np.lexsort((ids, check, keys))
    cut = C.group_starts(keys[order], check[order])
    i = ids[order]
    out = np.empty(len(keys), np.uint8)
    out[order] = i[cut][np.cumsum(cut) - 1] < i
    return out


def remove_repeats(packs: DataFrame, plan: Plan, schema: str, emit) -> DataFrame:
    """emit(tokens, mask of removed tokens) makes a record batch of the schema for each pack."""
    nb = C.buckets_for(packs, plan.keys_per_byte())
    # digests of pass 1 grow with the tokens, so that hardly any are equal by chance
    size = packs.agg(F.sum("n_bytes")).first()[0] or 0
    bits = min(64, 20 + int(size).bit_length())

    def opened(row):
        tokens = Tokens(C.Pack(row), plan)
        tokens.probes(bits)
        return tokens, tokens.first_pass()

    def first(batches):
        for row in C.rows_of(batches):
            key, flags = opened(row)[1]
            if (out := C.entries(row["pack_id"], key, [flags], nb)) is not None:
                yield out

    def second(batches):
        for row in C.rows_of(batches):
            tokens, _ = opened(row)
            key, *extras = tokens.second_pass(C.answer_bytes(row["a1"]))
            if (out := C.entries(row["pack_id"], key, extras, nb)) is not None:
                yield out

    def third(batches):
        for row in C.rows_of(batches):
            answer = C.answer_bytes(row["a2"])
            if not (answer == MIXED).any():
                continue
            tokens, _ = opened(row)
            tokens.second_pass(C.answer_bytes(row["a1"]))
            key, *extras = tokens.third_pass(answer)
            if (out := C.entries(row["pack_id"], key, extras, nb)) is not None:
                yield out

    def last(batches):
        for row in C.rows_of(batches):
            if row["a2"]:
                tokens, _ = opened(row)
                tokens.second_pass(C.answer_bytes(row["a1"]))
                answer = C.answer_bytes(row["a2"])
                tokens.third_pass(answer)
                gone = tokens.removed(answer, C.answer_bytes(row["a3"]))
            else:
                tokens = Tokens(C.Pack(row), plan)
                gone = np.zeros(tokens.n, bool)
            yield emit(tokens, gone)

    light = packs.drop("rest", "rest_lens", "also")
    # merged at every size: a broadcast of small answers would only be a second plan to test
    named = lambda df, name: df.withColumnRenamed("answers", name).hint("merge")
    a1 = named(C.answered(light.mapInArrow(C.tidied(first), C.ENTRY_SCHEMA), [np.uint8], _decide_anchor), "a1")
    a2 = named(C.answered(light.join(a1, "pack_id").mapInArrow(C.tidied(second), C.ENTRY_SCHEMA), [np.uint64, np.uint64, np.int64], _decide_context), "a2")
    a3 = named(C.answered(light.join(a1, "pack_id").join(a2, "pack_id").mapInArrow(C.tidied(third), C.ENTRY_SCHEMA), [np.uint64, np.int64], decide_window), "a3")
    known = a1.join(a2, "pack_id", "left").join(a3, "pack_id", "left")
    return packs.join(known.hint("merge"), "pack_id", "left").mapInArrow(C.tidied(last), schema)


def runs(mask: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask, cut at documents."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[first] = True
    here, before = np.append(mask, False), np.append(False, mask)
    return np.flatnonzero(here & (~before | edge)), np.flatnonzero(before & (~here | edge))


def span_lists(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """For each document its spans as start, end, start, end ..., counted from its first token."""
    cut = np.searchsorted(starts, first)
    begin = np.repeat(first[:-1], np.diff(cut))
    flat = np.stack([starts - begin, ends - begin], 1).reshape(-1).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(2 * cut, pa.int32()), pa.array(flat))
