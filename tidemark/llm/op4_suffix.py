"""Operator 4: suffix dedup on bytes by a radix sort of limited depth, most significant digit first.

No suffix is looked at beyond ``depth`` bytes, and every digit is the bytes themselves. A suffix is settled when any
digit inside its ``depth`` bytes stands in one document only, so the first pass orders one suffix in ``every``, chosen by
the bytes it starts with (equal digits are chosen alike), and the last pass orders all that it leaves.

1. Ranges. Some suffixes drawn at even steps from all packs give cuts in byte order, which deal suffixes to
   ranges of about equal size, and ranges to slices that are sorted one after the other (less lies on
   disk at a time). Cuts move load alone. From ``RANGES`` ranges on, each is dealt further by a hash.
2. First ``digit`` bytes: packs and ranges are sorted by them, digit by digit of as many bits as one sort of
   64-bit numbers takes, and each digit looks only at groups that are still mixed (``radix_order``).
   Groups of one document are settled, and so is each suffix that has such a digit among its ``depth``
   bytes. What is left, windows without a chosen digit too, stands in runs of neighbours.
3. Runs are cut into blocks at places that their bytes choose. Equal blocks count once, as repeated rows would: they are
   told apart by 128-bit digests, and one that also stands in a smaller document is repeated as a whole. In the
   first document of any other block, suffixes with a digit that stands in as many places as the block are
   settled: wherever such a suffix stands, the block stands around it, and in no smaller document.
4. Up to ``depth`` bytes: what is left of these first documents' suffixes is sorted on, in the same ranges.
   Equal ones are exactly the repeated strings.

Each pack sends its distinct digits once, sorted, so a string in a third of all documents is one entry of each pack.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import repeats as R

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept binary, rest string"
DRAWN_SCHEMA = "first binary, second binary"
#: Where runs begin and end, counts of their digits, blocks that lead and groups of the others, and the blocks' entries.
RUNS_SCHEMA = "pack_id long, lo binary, hi binary, counts binary, blocks binary, sent array<struct<bucket:int,pack_id:long,n:int,keys:binary,extra:binary>>"
LEADS_SCHEMA = "pack_id long, n long, ids binary, lens binary, data binary"
SENT = pa.struct([("bucket", pa.int32()), ("pack_id", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()), ("extra", pa.binary())])
#: About how many suffixes of a run make a block.
BLOCK = 16
#: Counts of places end here; what stands in so many or more is not settled by them.
MANY = 255
#: A slice of the last pass has about so many suffixes for as many bytes of text as one: a last digit has several times the bytes of a first one.
LAST_SHARE = 32
#: Fewer suffixes are not worth a slice of the last pass more.
SLICE_LEAST = 2_000_000
#: Most ranges, and suffixes drawn for each: what the driver and each task hold of them.
RANGES, DRAWN = 1 << 16, 16
#: Odd; its product with eight bytes decides which suffixes are chosen.
_CHOICE = np.uint64(0x9E3779B97F4A7C15)


def words_at(buf: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The ``size`` bytes from each place on, as numbers of eight bytes in byte order; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), np.dtype(">u8"), padded, strides=(1,))
    words = [eight[at + k].astype(np.uint64) for k in range(0, size, 8)]
    if size % 8:
        words[-1] &= ~np.uint64((1 << 8 * (8 - size % 8)) - 1)
    return words


def chosen_at(buf: np.ndarray, size: int, every: int) -> np.ndarray:
    """True for about one place in ``every``, by the ``size`` bytes there, eight at most."""
    if every == 1:
        return np.ones(len(buf), bool)
    eight = np.ndarray((len(buf),), np.dtype(">u8"), np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,)).astype(np.uint64)
    if size < 8:
        eight &= ~np.uint64((1 << 8 * (8 - size)) - 1)
    eight *= _CHOICE
    return eight < np.uint64((1 << 64) // every)


def radix_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order of their words, and where groups of equal rows begin; equal rows keep their order.

    Most significant digit first: a digit has the bits that a 64-bit key holds beside a row's group and
    place, rows alone in their group are not looked at again, and groups that have a word in common skip it.
    """
    n = len(words[0])
    order, new, live = np.arange(n), np.arange(n) == 0, np.arange(n)
    for word, values in enumerate(words):
        rows, done = live, 0
        if word:
            live = live[~(new[live] & np.append(new[1:], True)[live])]
            if not len(live):
                break
            # groups whose rows have the whole word in common need no sort by it
            at, own = values[order[live]], new[live]
            starts = np.flatnonzero(own)
            differ = np.append(False, at[1:] != at[:-1]) & ~own
            rows = live[np.repeat(np.logical_or.reduceat(differ, starts), np.diff(np.append(starts, len(live))))]
        while len(rows) and done < 64:
            place, grouped = np.uint64(len(rows).bit_length()), word > 0 or done > 0
            bits = min(64 - done, 64 - int(place) * (2 if grouped else 1))
            digit = values[order[rows]] << np.uint64(done) >> np.uint64(64 - bits)
            key = (digit << place) | np.arange(len(rows), dtype=np.uint64)
            if grouped:
                key |= (np.cumsum(new[rows]) - 1).astype(np.uint64) << (place + np.uint64(bits))
            key.sort()
            order[rows] = order[rows[(key & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)]]
            new[rows] |= C.group_starts(key >> place)
            rows = rows[~(new[rows] & np.append(new[1:], True)[rows])]
            done += bits
    return order, new


@dataclass(frozen=True)
class Deal:
    """Ranges of suffixes by cuts in byte order, over how many buckets each is spread, and ranges to a slice."""

    first: np.ndarray
    second: np.ndarray
    spread: int
    slices: int

    @staticmethod
    def of(words: list[np.ndarray], ranges: int, spread: int, slices: int) -> Deal:
        """Cuts from drawn suffixes."""
        order = radix_order(words)[0]
        at = order[(np.arange(1, ranges) * len(order)) // ranges] if len(order) else order
        first, second = words[0][at], words[1][at]
        own = C.group_starts(first, second)
        return Deal(first[own], second[own], spread, slices)

    @property
    def each(self) -> int:
        return -(-(len(self.first) + 1) // self.slices)

    def inside(self, first: np.ndarray, part: int) -> np.ndarray:
        """Places that may be in a slice, by their first eight bytes."""
        lo, hi = part * self.each - 1, (part + 1) * self.each - 1
        out = np.ones(len(first), bool)
        if lo >= len(self.first):
            return ~out
        if lo >= 0:
            out &= first >= self.first[lo]
        return out & (first <= self.first[hi]) if hi < len(self.first) else out

    def buckets(self, words: list[np.ndarray]) -> np.ndarray:
        """The bucket of each of some sorted distinct rows."""
        first, second = words[0], words[1] if len(words) > 1 else np.zeros_like(words[0])
        at, end = np.searchsorted(first, self.first), np.searchsorted(first, self.first, side="right")
        for k in np.flatnonzero(end > at):
            at[k] += np.searchsorted(second[at[k] : end[k]], self.second[k])
        out = np.cumsum(np.bincount(at, minlength=len(first) + 1))[: len(first)]
        if self.spread > 1:
            spread = ((C.mix(first ^ C.mix(second)) >> np.uint64(32)) * np.uint64(self.spread)) >> np.uint64(32)
            out = out * self.spread + spread.astype(np.int64)
        return out

    def slice_of(self, bucket: np.ndarray) -> np.ndarray:
        return bucket // self.spread // self.each


class Sorted:
    """Some suffixes of a pack in the order of their first ``size`` bytes, and their distinct digits by bucket."""

    def __init__(self, buf: np.ndarray, at: np.ndarray, size: int, deal: Deal, part: int | None = None):
        if part is not None:
            at = at[deal.inside(words_at(buf, at, 8)[0], part)]
        words = words_at(buf, at, size)
        self.order, new = radix_order(words)
        lead = self.order[new]
        self.words = [w[lead] for w in words]
        self.bucket, self.group = deal.buckets(self.words), np.cumsum(new) - 1
        if part is not None:
            own = deal.slice_of(self.bucket) == part
            here = own[self.group]
            self.order, self.words, self.bucket = self.order[here], [w[own] for w in self.words], self.bucket[own]
            self.group = (np.cumsum(own) - 1)[self.group[here]]
        if deal.spread > 1:
            turn = np.argsort(self.bucket, kind="stable")
            place = np.empty_like(turn)
            place[turn] = np.arange(len(turn))
            self.words, self.bucket = [w[turn] for w in self.words], self.bucket[turn]
            self.group = place[self.group]
        self.at = at

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each group; values: one per suffix."""
        out = np.empty(len(self.bucket), np.int64)
        if len(out):
            starts = np.flatnonzero(C.group_starts(self.group))
            out[self.group[starts]] = np.minimum.reduceat(values[self.order], starts)
        return out

    def entries(self, pack_id: int, extra: list[np.ndarray]) -> pa.RecordBatch | None:
        import zstandard

        if not len(self.bucket):
            return None
        press = zstandard.ZstdCompressor(level=1)
        cut = np.append(np.flatnonzero(C.group_starts(self.bucket)), len(self.bucket))
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        keys = [press.compress(b"".join(_planes(w[a:z] if k else np.diff(w[a:z], prepend=np.uint64(0))) for k, w in enumerate(self.words))) for a, z in spans]
        extras = [press.compress(b"".join(_planes(x[a:z]) for x in extra)) for a, z in spans]
        return C.batch_of(C.ENTRY_SCHEMA, [self.bucket[cut[:-1]], np.full(len(spans), pack_id), np.diff(cut), keys, extras])


def _planes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()


def _unpressed(words: int):
    """Reads the keys of Sorted.entries: a row of words for each."""

    def unpress(data: bytes, n: int) -> np.ndarray:
        import zstandard

        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * words * n), np.uint8)
        out = raw.reshape(words, 8, n).transpose(2, 0, 1).copy().view(np.uint64).reshape(n, words)
        out[:, 0] = np.cumsum(out[:, 0], dtype=np.uint64)
        return out

    return unpress


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A bucket in byte order, and the group of each row in it."""
    order, new = radix_order([np.ascontiguousarray(w) for w in keys.T])
    return order, np.cumsum(new) - 1


def _decide_digit(keys, who, extras):
    """1 for digits of one document; else in how many places a digit stands, MANY at most."""
    order, group = _grouped(keys)
    several, counts = extras
    shared = np.bincount(group, 1 + several[order]) > 1
    count = np.minimum(np.bincount(group, counts[order]), MANY)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(shared, count, 1).astype(np.uint8)[group]
    return out


def _decide_block(keys, who, extras):
    """0 for blocks that a smaller document has too; else in how many places they stand, MANY at most."""
    check, ids, counts = extras
    order = np.lexsort((ids, check, keys))
    cut = C.group_starts(keys[order], check[order])
    group, i = np.cumsum(cut) - 1, ids[order]
    count = np.minimum(np.bincount(group, counts[order]), MANY).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(i[cut][group] < i, 0, count[group])
    return out


def _decide_last(keys, who, extras):
    """1 for strings that a smaller document has too."""
    order, group = _grouped(keys)
    ids = extras[0][order]
    least = np.minimum.reduceat(ids, np.flatnonzero(C.group_starts(group))) if len(ids) else ids
    out = np.empty(len(keys), np.uint8)
    out[order] = ids > least[group]
    return out


class Suffixes:
    """The suffixes of a pack's documents of at least ``depth`` bytes."""

    def __init__(self, pack: C.Pack, depth: int, digit: int, every: int):
        self.pack, self.depth, self.size = pack, depth, digit
        counts = np.diff(pack.offsets)
        self.here = np.repeat(counts >= depth, counts)
        end = np.minimum(counts, digit - 1)
        self.here[C.ranges(pack.offsets[1:] - end, end)] = False
        self.chosen = np.flatnonzero(self.here & chosen_at(pack.buf, digit, every))

    def drawn(self, step: int) -> list[np.ndarray]:
        """The digits of every step-th chosen suffix."""
        first = int(C.mix(np.array([self.pack.pack_id], np.uint64))[0] % np.uint64(step))
        words = words_at(self.pack.buf, self.chosen[first::step], self.size)
        return words if len(words) > 1 else [*words, np.zeros_like(words[0])]

    def send(self, deal: Deal, part: int) -> pa.RecordBatch | None:
        """Entries of a slice: distinct digits, whether several documents of the pack have them, and in how many places they stand."""
        found = Sorted(self.pack.buf, self.chosen, self.size, deal, part)
        doc = (np.searchsorted(self.pack.offsets, found.at, side="right") - 1)[found.order]
        n = len(found.bucket)
        first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
        last[found.group] = doc  # equal digits stand in order of place
        first[found.group[::-1]] = doc[::-1]
        count = np.minimum(np.bincount(found.group, minlength=n), MANY)
        return found.entries(self.pack.pack_id, [(first != last).astype(np.uint8), count.astype(np.uint8)])

    def runs(self, deal: Deal, answer: np.ndarray, nb: int) -> pa.RecordBatch:
        """Runs in which all chosen digits of all suffixes are shared, their blocks, and the blocks' entries."""
        import zstandard

        found = Sorted(self.pack.buf, self.chosen, self.size, deal)
        counts = np.zeros(len(self.pack.buf), np.uint8)
        counts[self.chosen[found.order]] = answer[found.group]
        width = self.depth - self.size + 1
        lo, hi = R.runs(self.here & (counts != 1), self.pack.offsets)
        long = hi - lo >= width
        lo, hi = lo[long], hi[long] - width
        runs = Runs(self.pack, self.depth, self.size, lo, hi, counts)
        sent = C.entries(self.pack.pack_id, *runs.whole(), nb)
        blocks = sent.to_struct_array() if sent is not None else pa.array([], SENT)
        press = zstandard.ZstdCompressor(level=1)
        data = press.compress(counts[C.ranges(lo, hi - lo + width)].tobytes())
        row = [self.pack.pack_id, lo.tobytes(), hi.tobytes(), data, press.compress(_planes(runs.places()))]
        return pa.RecordBatch.from_arrays([*[pa.array([x]) for x in row], pa.ListArray.from_arrays(pa.array([0, len(blocks)], pa.int32()), blocks)], names=["pack_id", "lo", "hi", "counts", "blocks", "sent"])


class Runs:
    """Runs of suffixes of a pack that are still in groups of several documents, in blocks."""

    def __init__(self, pack: C.Pack, depth: int, digit: int, lo: np.ndarray, hi: np.ndarray, counts: np.ndarray):
        self.pack, self.depth, self.width, self.counts = pack, depth, depth - digit + 1, counts
        at, count = C.ranges(lo, hi - lo + 1), hi - lo + 1
        cut = chosen_at(pack.buf, digit, BLOCK)[at]
        cut[np.cumsum(count) - count] = True
        self.lo, self.hi = at[cut], at[np.append(cut[1:], True)[: len(at)]]
        self.id = self.ids_at(self.lo)

    @staticmethod
    def read(row: dict, depth: int, digit: int) -> Runs:
        """A pack's runs as they were written, with the groups of their blocks."""
        import zstandard

        press, pack = zstandard.ZstdDecompressor(), C.Pack(row)
        lo, hi = (np.frombuffer(row[c], np.int64) for c in ("lo", "hi"))
        counts, digits = np.zeros(len(pack.buf), np.uint8), C.ranges(lo, hi - lo + depth - digit + 1)
        if len(lo):
            counts[digits] = np.frombuffer(press.decompress(row["counts"], max_output_size=len(digits)), np.uint8)
        runs = Runs(pack, depth, digit, lo, hi, counts)
        n = len(runs.lo)
        places = C.unplanes(row["blocks"], len(press.decompress(row["blocks"], max_output_size=max(1, 8 * n))) // 4, np.int32).astype(np.int64) if n else runs.lo
        runs.lead = places[: 2 * n - len(places)]
        others, groups = np.split(places[len(runs.lead) :], 2)
        runs.group = np.empty(n, np.int64)
        runs.group[runs.lead] = np.arange(len(runs.lead))
        runs.group[others] = groups
        return runs

    def places(self) -> np.ndarray:
        """Blocks that lead, in order of their groups, then the others and their groups."""
        others = np.ones(len(self.lo), bool)
        others[self.lead] = False
        others = np.flatnonzero(others)
        return np.concatenate([self.lead, others, self.group[others]]).astype(np.int32)

    def whole(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """Entries of whole blocks: two lanes of their hash, least id, in how many places of the pack they stand."""
        key, check = (C.bytes_hashes(self.pack.buf, self.lo, self.hi + self.depth, lane) for lane in (0, 1))
        order = np.lexsort((self.id, check, key))
        cut = C.group_starts(key[order], check[order])
        self.group = np.empty(len(key), np.int64)
        self.group[order] = np.cumsum(cut) - 1 if len(key) else order
        self.lead = order[cut] if len(key) else order
        count = np.bincount(self.group, minlength=len(self.lead))
        return key[self.lead], [check[self.lead], self.id[self.lead], np.minimum(count, MANY).astype(np.uint8)]

    def open(self, covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last suffix of each run of suffixes of blocks that lead and aren't covered, without a digit of just the block's places."""
        at = np.flatnonzero(covered)
        lo, n, count = self.lo[self.lead[at]], (self.hi - self.lo + 1)[self.lead[at]], covered[at]
        digits = n + self.width - 1
        count = np.repeat(count, digits)
        same = np.append(0, np.cumsum((self.counts[C.ranges(lo, digits)] == count) & (count < MANY)))
        first = C.ranges(np.cumsum(digits) - digits, n)
        left = np.zeros(len(self.pack.buf), bool)
        left[C.ranges(lo, n)] = same[first + self.width] == same[first]
        return self.neighbours(np.flatnonzero(left), 1)

    def neighbours(self, at: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last of each run of places of one document that are ``gap`` apart at most."""
        new = np.ones(len(at), bool)
        new[1:] = np.diff(at) > gap
        if self.depth == 1:  # else those of two documents are never so near
            edge = np.zeros(len(self.pack.buf) + 1, bool)
            edge[self.pack.offsets] = True
            new |= edge[at]
        return at[new], at[np.append(new[1:], True)[: len(at)]]

    def ids_at(self, lo: np.ndarray) -> np.ndarray:
        return self.pack.ids[np.searchsorted(self.pack.offsets, lo, side="right") - 1]

    def leads(self, covered: np.ndarray) -> list:
        """How many suffixes are open, and the texts of their runs: ids, lengths and bytes."""
        import zstandard

        lo, hi = self.open(covered)
        lens = hi - lo + self.depth
        data = zstandard.ZstdCompressor(level=1).compress(self.pack.buf[C.ranges(lo, lens)].tobytes())
        return [self.pack.pack_id, int((hi - lo + 1).sum()), self.ids_at(lo).tobytes(), lens.tobytes(), data]

    def removed(self, covered: np.ndarray, repeated: np.ndarray, deal: Deal) -> np.ndarray:
        """Mask of the bytes that repeated strings cover. Blocks like a pack's leading one in a larger document go whole."""
        gone = np.zeros(len(self.pack.buf), bool)
        if len(self.lo):
            whole = (covered[self.group] == 0) | (self.id > self.id[self.lead][self.group])
            lo, hi = self.open(covered)
            found, ids, least = last_digits(self.pack.buf, lo, hi, self.ids_at(lo), self.depth, deal)
            verdict = np.empty(len(ids), bool)
            verdict[found.order] = (repeated[found.group] > 0) | (ids[found.order] > least[found.group])
            repeats = np.zeros(len(self.pack.buf), bool)
            repeats[C.ranges(lo, hi - lo + 1)[verdict]] = True
            # equal blocks of the leading document share the verdict of its first
            rest = np.flatnonzero(~whole)
            count = self.hi[rest] - self.lo[rest] + 1
            at = C.ranges(self.lo[rest], count)[repeats[C.ranges(self.lo[self.lead[self.group[rest]]], count)]]
            starts = np.zeros(len(self.pack.buf), bool)
            starts[at] = True
            starts[C.ranges(self.lo[whole], (self.hi - self.lo + 1)[whole])] = True
            first, last = self.neighbours(np.flatnonzero(starts), 1)
            gone[C.ranges(first, last - first + self.depth)] = True
        return gone


def last_digits(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray, run_ids: np.ndarray, depth: int, deal: Deal, part: int | None = None) -> tuple[Sorted, np.ndarray, np.ndarray]:
    """The suffixes of some runs by all their bytes, the id of each, and the least id of equal ones."""
    count = hi - lo + 1
    suffix, ids = C.ranges(lo, count), np.repeat(run_ids, count)
    if part is not None:
        here = deal.inside(words_at(buf, suffix, 8)[0], part)
        suffix, ids = suffix[here], ids[here]
    found = Sorted(buf, suffix, depth, deal, part)
    return found, ids, found.least(ids)


def _lead_digits(row: dict, depth: int, deal: Deal, part: int) -> pa.RecordBatch | None:
    """Entries of a slice of the suffixes of a pack's leading runs."""
    import zstandard

    ids, lens = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["lens"], np.int64)
    buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, int(lens.sum()))), np.uint8)
    lo = np.cumsum(lens) - lens
    found, _, least = last_digits(buf, lo, lo + lens - depth, ids, depth, deal, part)
    return found.entries(row["pack_id"], [least])


def suffix_dedup(docs: DataFrame, depth: int = 50, digit: int = 16, text: str = "text", key: str = "doc_id", carry: list[str] = (), slices: int = 2, every: int = 6) -> DataFrame:
    """Remove each byte covered by a ``depth``-byte string that also starts in a document with a smaller id.

    Suffixes are sorted by their first ``digit`` bytes, 16 at most, and those still in mixed groups by
    their first ``depth`` bytes (see above).
    every: of about how many suffixes one is sorted by ``digit`` bytes; moves work alone.
    slices: parts, in byte order, in which passes go over the texts; more of them hold less on disk at a time.

    Returns doc_id, n_bytes, n_removed, n_spans, spans (start and end of each removed run, in
    bytes), kept (remaining bytes) and rest (JSON of the carried columns).
    A null text counts as empty. Rows of one doc_id are judged alone and never remove one
    another's bytes; a null doc_id ranks last. Other columns play no part. An empty table
    gives no rows.
    """
    digit = min(digit, depth, 16)
    packs = C.packed(docs, text, key, carry)
    light = packs.drop("rest", "rest_lens", "also")

    total = light.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = max(slices * C.shuffle_partitions(docs.sparkSession), total // C.BUCKET_KEYS + 1)
    ranges = min(buckets, RANGES)
    step = max(1, total // (every * ranges * DRAWN))

    def drawn(batches):
        for row in C.rows_of(batches):
            first, second = Suffixes(C.Pack(row), depth, digit, every).drawn(step)
            yield C.batch_of(DRAWN_SCHEMA, [[first.tobytes()], [second.tobytes()]])

    # no more than about RANGES * DRAWN suffixes of 16 bytes, whatever the size of the table
    found = light.mapInArrow(C.tidied(drawn), DRAWN_SCHEMA).toPandas()
    deal = Deal.of([np.frombuffer(b"".join(found[c]), np.uint64) for c in ("first", "second")], ranges, -(-buckets // ranges), slices)

    def second(part):
        def send(batches):
            for row in C.rows_of(batches):
                if (out := Suffixes(C.Pack(row), depth, digit, every).send(deal, part)) is not None:
                    yield out

        return C.replies(light.mapInArrow(C.tidied(send), C.ENTRY_SCHEMA), [np.uint8, np.uint8], _decide_digit, _unpressed(-(-digit // 8)))

    def left(batches):
        for row in C.rows_of(batches):
            yield Suffixes(C.Pack(row), depth, digit, every).runs(deal, C.answer_bytes(row["digits"]), nb)

    def opened(batches):
        for row in C.rows_of(batches):
            runs = Runs.read(row, depth, digit)
            yield C.batch_of(LEADS_SCHEMA, [[x] for x in runs.leads(C.answer_bytes(row["covered"]))])

    def fourth(part):
        def send(batches):
            for row in C.rows_of(batches):
                if (out := _lead_digits(row, depth, thin, part)) is not None:
                    yield out

        return C.replies(leads.mapInArrow(C.tidied(send), C.ENTRY_SCHEMA), [np.int64], _decide_last, _unpressed(-(-depth // 8)))

    def last(batches):
        for row in C.rows_of(batches):
            runs, covered = Runs.read(row, depth, digit), C.answer_bytes(row["covered"])
            yield emit(runs.pack, runs.removed(covered, C.answer_bytes(row["repeated"]), deal))

    def emit(p: C.Pack, gone: np.ndarray):
        first = p.offsets
        starts, ends = R.runs(gone, first)
        before = np.concatenate([[0], np.cumsum(gone)])[first]
        kept = C.strings(p.buf[~gone], first - before, pa.binary())
        return C.batch_of(SCHEMA, [p.id_column(), np.diff(first), np.diff(before), np.diff(np.searchsorted(starts, first)), R.span_lists(starts, ends, first), kept, p.rest()])

    nb = C.buckets_for(packs, 1 / 8)
    answers = C.written_all(second(part) for part in range(deal.slices))
    digits = _of_packs(answers, "digits")
    runs = C.written(light.join(digits, "pack_id", "left").mapInArrow(C.tidied(left), RUNS_SCHEMA))
    C.dropped(answers)
    covered = _of_packs(C.written(C.replies(runs.select(F.inline("sent")), [np.uint64, np.int64, np.uint8], _decide_block)), "covered")
    runs = runs.drop("sent").hint("merge")
    leads = C.written(light.join(runs, "pack_id").join(covered, "pack_id").mapInArrow(C.tidied(opened), LEADS_SCHEMA))
    n = leads.agg(F.sum("n")).first()[0] or 0
    thin = replace(deal, slices=max(slices, min(LAST_SHARE * n // max(1, total), n // SLICE_LEAST) + 1))
    repeated = _of_packs(C.written_all(fourth(part) for part in range(thin.slices)), "repeated")
    C.dropped(leads)
    return packs.join(runs, "pack_id").join(covered, "pack_id", "left").join(repeated, "pack_id", "left").mapInArrow(C.tidied(last), SCHEMA)


def _of_packs(answers: DataFrame, name: str) -> DataFrame:
    """One row per pack with the answers of all slices; merged at every size."""
    return answers.groupBy("pack_id").agg(F.sort_array(F.flatten(F.collect_list("answers"))).alias(name)).hint("merge")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
