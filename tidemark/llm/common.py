"""Shared plumbing: table access, written intermediate tables, packs of documents, keyed exchanges.

A *pack* is one row that holds about ``PACK_BYTES`` of text of whole documents.
Packs let Python work on flat numpy arrays, and let an exchange send one
compact blob per (pack, bucket) in place of one row per token.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_BYTES = 2_000_000
#: Most keys of one bucket of an exchange, which bounds a reducer's memory.
BUCKET_KEYS = 2_000_000
NULL_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, a temporary one in local mode only.

    Executors of a cluster share no temporary folder, so there an unset one is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, for tables with very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def written(df: DataFrame) -> DataFrame:
    """Write df under the shared folder and read it back: cuts lineage, survives lost executors.

    The shuffle files of the write go when it ends, so stages don't add up on disk.
    """
    return written_all([df])


def written_all(dfs) -> DataFrame:
    """Write DataFrames of one schema, one after the other, as one table."""
    path, schema = None, None
    for df in dfs:
        spark = df.sparkSession
        small_batches(spark)
        path = path or f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        schema = schema or df.schema
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = spark.conf.get(key, "false")
        spark.conf.set(key, "true")
        try:
            df.write.mode("append").option("compression", "zstd").parquet(path)
        finally:
            spark.conf.set(key, before)
    return spark.read.schema(schema).parquet(path)


def release() -> None:
    """Give freed memory back: idle Python workers stay beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(f):
    """f, a function of record batches, with memory given back when it ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def slices(batches, column: int, size: int = 1_000_000):
    """Batches cut so that the texts of a column hold about ``size`` bytes, or one row."""
    for b in batches:
        offsets = column_bytes(b.column(column))[1]
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
            yield b.slice(at, to - at)
            at = to


def dropped(*dfs: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getName().startswith("tidemark-"):
                with contextlib.suppress(Exception):
                    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    gc.collect()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def drawn(column, share: float):
    """True for about this share of the values of a column, by their hash; any share, however small."""
    return F.xxhash64(column) < F.lit(min((1 << 63) - 1, int(share * 2.0**64) - (1 << 63)))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


_FIRST, _LANE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)
#: Places hashed at a time, so that intermediate arrays stay in a core's cache.
_SOME = 1 << 14
#: Bytes from which a run is hashed by BLAKE2b.
_LONG = 256


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a followed by b. Mixed at each joint, so no pattern of tokens cancels out at any length."""
    h = a * _FIRST
    h += b
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def run_hashes(values: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """64-bit hash of each run of ``size`` values, by where it starts. Two lanes make 128 bits.

    Runs of 1, 2, 4 ... values are joined in pairs; two that overlap make up any other size.
    Bytes (values of one byte) begin with runs of eight, as they are.
    """
    n = max(0, len(values) - size + 1)
    out = np.empty(n, np.uint64)
    whole = values.itemsize == 1 and size >= 8
    eight = _eights(values) if whole else None
    for lo in range(0, n, _SOME):
        hi = min(n, lo + _SOME)
        if whole:
            h, have = eight[lo : hi + size - 8].copy(), 8
        else:
            h, have = values[lo : hi + size - 1], 1
            h = _BYTES[h] if values.itemsize == 1 else h
        h = mix(h ^ _LANE) if lane else h
        while 2 * have <= size:
            h = joined(h[:-have], h[have:])
            have *= 2
        if have < size:
            h = joined(h[: have - size], h[size - have :])
        out[lo:hi] = h
    return mix(out) if size == 8 and whole else out


def _eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.ndarray((len(buf) + 1,), np.dtype("<u8"), padded, strides=(1,))


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end], of any lengths above 0, the same wherever the same values stand."""
    length = end - start
    level = np.frexp(length.astype(np.float64))[1] - 1
    out = np.empty(len(start), np.uint64)
    for k in np.unique(level).tolist():
        at = np.flatnonzero(level == k)
        runs = run_hashes(values, 1 << k, lane)
        out[at] = joined(joined(runs[start[at]], runs[end[at] - (1 << k)]), length[at].astype(np.uint64))
    return out


def bytes_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, lane: int = 0) -> np.ndarray:
    """64-bit hash of buf[start:end]: eight bytes at a time, long runs by BLAKE2b. Two lanes make 128 bits."""
    eight = _eights(buf)
    length = end - start
    out = mix(length.astype(np.uint64) + (_FIRST if lane else _LANE))
    live, at = np.flatnonzero((length > 0) & (length < _LONG)), 0
    while len(live):
        left = length[live] - at
        out[live] = joined(out[live], eight[start[live] + at] & _MASKS[np.minimum(left, 8)])
        at += 8
        live = live[left > 8]
    long = np.flatnonzero(length >= _LONG)
    if len(long):
        data, key = buf.tobytes(), bytes([lane])
        digests = b"".join(hashlib.blake2b(data[a:z], digest_size=8, key=key).digest() for a, z in zip(start[long].tolist(), end[long].tolist(), strict=True))
        out[long] = np.frombuffer(digests, "<u8")
    return out


#: The first k bytes of eight.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z become a-z."""
    return _LOWER[buf]


def word_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in buf of runs of bytes outside [\\x20\\x09-\\x0D], and each document's first word."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[buf], out=inside[:n])
    is_cut = np.zeros(n + 1, bool)
    is_cut[offsets] = True
    before = np.zeros(n + 1, bool)
    before[1:] = inside[:n]
    starts = np.flatnonzero(inside & (~before | is_cut))
    ends = np.flatnonzero(before & (~inside | is_cut))
    return starts, ends, np.searchsorted(starts, offsets)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; null counts as empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def column_ids(column: pa.Array) -> np.ndarray:
    """Ids as int64; null ranks after every id."""
    if column.null_count:
        column = column.fill_null(int(NULL_ID))
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


PACK_SCHEMA = "pack_id long, ids binary, nulls binary, lens binary, data binary, n_bytes long, rest_lens binary, rest binary, also binary"
#: Bits of a document's place in its pack; pack_id << PLACE_BITS | place names a row of the input.
PLACE_BITS = 14


def packed(docs: DataFrame, text: str = "text", key: str = "doc_id", carry: list[str] = (), also=None, level: int = 1) -> DataFrame:
    """Whole documents in packs of about PACK_BYTES, written once. nulls marks texts that are null.

    carry: further columns that come back with each document, as JSON in ``rest``.
    also: makes a further binary column from a pack's bytes and offsets.
    """

    def pack(batches):
        import zstandard
        from pyspark import TaskContext

        press, part, n = zstandard.ZstdCompressor(level=level), TaskContext.get().partitionId(), 0
        held, size, rows = [], 0, 0

        def out():
            nonlocal n, held, size, rows
            ids, nulls, lens, data, rest_lens, rest = (np.concatenate(x) for x in zip(*held, strict=True))
            more = also(data, np.concatenate([[0], np.cumsum(lens)])) if also else b""
            row = [(part << 24) | n, ids.tobytes(), nulls.tobytes(), lens.tobytes(), press.compress(data.tobytes()), len(data), rest_lens.tobytes(), press.compress(rest.tobytes()), more]
            n, held, size, rows = n + 1, [], 0, 0
            return batch_of(PACK_SCHEMA, [[x] for x in row])

        for b in batches:
            ids, nulls = column_ids(b.column(0)), b.column(1).is_null().to_numpy(zero_copy_only=False)
            buf, off = column_bytes(b.column(1))
            more, more_off = column_bytes(b.column(2))
            at = 0
            while at < len(ids):
                room = PACK_BYTES - size
                to = min(len(ids), at + (1 << PLACE_BITS) - rows, max(at + 1, int(np.searchsorted(off, off[at] + room, side="right")) - 1))
                held.append((ids[at:to], nulls[at:to], np.diff(off[at : to + 1]), buf[off[at] : off[to]], np.diff(more_off[at : to + 1]), more[more_off[at] : more_off[to]]))
                size += int(off[to] - off[at])
                rows += to - at
                at = to
                if size >= PACK_BYTES * 3 // 4 or rows >= 1 << PLACE_BITS:
                    yield out()
        if held:
            yield out()

    rest = F.to_json(F.struct(*[docs[c] for c in carry])) if carry else F.lit("")
    return written(docs.select(docs[key].cast("long").alias("id"), docs[text].cast("string").alias("text"), rest.alias("rest")).mapInArrow(tidied(pack), PACK_SCHEMA))


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def batch_of(schema: str, columns: list) -> pa.RecordBatch:
    """A record batch of a schema of plain types."""
    fields = [x.strip().rsplit(" ", 1) for x in schema.split(",")]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[f for f, _ in fields])


class Pack:
    """One pack, opened."""

    def __init__(self, row: dict):
        import zstandard

        self.pack_id = row["pack_id"]
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.nulls = np.frombuffer(row["nulls"], bool)
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(row["lens"], np.int64))])
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=max(1, row["n_bytes"])), np.uint8)
        self.row = row

    def rest(self) -> pa.Array:
        """The carried columns of each document, as JSON."""
        import zstandard

        lens = np.frombuffer(self.row["rest_lens"], np.int64)
        data = zstandard.ZstdDecompressor().decompress(self.row["rest"], max_output_size=max(1, int(lens.sum())))
        return strings(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum(lens)]))

    def id_column(self) -> pa.Array:
        return pa.array(self.ids, pa.int64(), mask=self.ids == NULL_ID)


def strings(data: np.ndarray, offsets: np.ndarray, kind=None, nulls: np.ndarray | None = None) -> pa.Array:
    """A string (or binary) array made of its bytes and offsets."""
    mask = None if nulls is None or not nulls.any() else pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes())
    return pa.Array.from_buffers(kind or pa.string(), len(offsets) - 1, [mask, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(data).tobytes())])


def rows_of(batches):
    """Rows of record batches as dictionaries, one at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield {name: b.column(c)[k].as_py() for c, name in enumerate(b.schema.names)}


# --- keyed exchange -------------------------------------------------------------------
#
# Each pack sends its distinct keys, sorted and cut into buckets by their top bits, with
# a payload for each key. The reducer of a bucket answers one byte for each key, in the
# order sent. A hot key is one entry of each pack however often it occurs there.

ENTRY_SCHEMA = "bucket int, pack_id long, n int, keys binary, extra binary"
ANSWER_SCHEMA = "bucket int, pack_id long, answer binary"


def buckets_for(packs: DataFrame, keys_per_byte: float) -> int:
    """Enough buckets that none holds more than about BUCKET_KEYS keys."""
    total = packs.agg(F.sum("n_bytes")).first()[0] or 0
    return max(shuffle_partitions(packs.sparkSession), int(total * keys_per_byte / BUCKET_KEYS) + 1)


def planes(a: np.ndarray) -> bytes:
    """Byte planes of an array, pressed: sorted keys have near-constant high planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())


def unplanes(data: bytes, n: int, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * size)), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).reshape(n)


def bucket_of(keys: np.ndarray, nb: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(nb)) >> np.uint64(32)


def entries(pack_id: int, keys: np.ndarray, extras: list[np.ndarray], nb: int) -> pa.RecordBatch | None:
    """keys sorted by value; extras: arrays of the same length."""
    import zstandard

    if not len(keys):
        return None
    cuts = np.searchsorted(bucket_of(keys, nb), np.arange(nb + 1, dtype=np.uint64))
    full = np.flatnonzero(np.diff(cuts))
    press = zstandard.ZstdCompressor(level=1)
    key_blobs, extra_blobs = [], []
    for b in full:
        lo, hi = cuts[b], cuts[b + 1]
        key_blobs.append(planes(keys[lo:hi]))
        extra_blobs.append(press.compress(b"".join(np.ascontiguousarray(x[lo:hi].view(np.uint8).reshape(hi - lo, x.itemsize).T).tobytes() for x in extras)))
    return batch_of(ENTRY_SCHEMA, [full, np.full(len(full), pack_id), np.diff(cuts)[full], key_blobs, extra_blobs])


def extras_of(rows: list[dict], kinds: list) -> list[np.ndarray]:
    """The payload arrays of entries."""
    import zstandard

    extras = [[] for _ in kinds]
    for r in rows:
        n, at = r["n"], 0
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["extra"], max_output_size=max(1, n * sum(np.dtype(k).itemsize for k in kinds))), np.uint8)
        for x, kind in zip(extras, kinds, strict=True):
            size = np.dtype(kind).itemsize
            x.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).reshape(n))
            at += n * size
    return [np.concatenate(x) for x in extras]


def per_group(reduce):
    """A function of the batches of a group, with the types by which applyInArrow knows it."""

    def of_group(batches):
        try:
            yield from reduce(batches)
        finally:
            release()

    of_group.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return of_group


def answered(sent: DataFrame, kinds: list, decide) -> DataFrame:
    """replies, written."""
    return written(replies(sent, kinds, decide))


def replies(sent: DataFrame, kinds: list, decide, unpress=None) -> DataFrame:
    """One row per pack with the sorted answers of all its buckets.

    decide(keys, pack index of each entry, extras) returns a byte per entry.
    unpress(data, n) reads keys that were not written by entries().
    """
    unpress = unpress or (lambda data, n: unplanes(data, n, np.uint64))

    def reduce(batches):
        import zstandard

        rows = list(rows_of(batches))
        keys = np.concatenate([unpress(r["keys"], r["n"]) for r in rows])
        n = np.array([r["n"] for r in rows])
        out = decide(keys, np.repeat(np.arange(len(rows)), n), extras_of(rows, kinds)).astype(np.uint8)
        cuts = np.concatenate([[0], np.cumsum(n)])
        press = zstandard.ZstdCompressor(level=1)
        for lo in range(0, len(rows), 4096):
            some = range(lo, min(lo + 4096, len(rows)))
            yield batch_of(ANSWER_SCHEMA, [[rows[k]["bucket"] for k in some], [rows[k]["pack_id"] for k in some], [press.compress(out[cuts[k] : cuts[k + 1]].tobytes()) for k in some]])

    out = sent.groupBy("bucket").applyInArrow(per_group(reduce), ANSWER_SCHEMA)
    return out.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "answer"))).alias("answers"))


def answer_bytes(answers) -> np.ndarray:
    """All of a pack's answers, in the order of its sorted keys."""
    import zstandard

    if not answers:
        return np.zeros(0, np.uint8)
    d = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(d.decompress(x["answer"]) for x in answers), np.uint8)


def ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin, begin + 1 ... for ``count`` places, one range after the other."""
    return np.repeat(begin - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def group_starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """True where a run of equal rows of sorted columns begins."""
    n = len(sorted_columns[0])
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return out
