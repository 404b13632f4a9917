"""Operator 2: BPE encoding and decoding, with reuse of content-defined chunks."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: A chunk ends where the hash of the ROLL bytes before it has CUT_BITS zero bits: 512 bytes on average.
ROLL, CUT_BITS = 16, 9
#: Shorter chunks aren't worth an exchange.
LEAST = 64
#: Fixed value: the pre-tokeniser pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OUT_SCHEMA = "doc_id long, ids array<int>, decoded string, rest string"
POST_SCHEMA = "bucket int, pack_id long, asks boolean, n int, keys binary, lens binary, ids binary"
GIVE_SCHEMA = "bucket int, pack_id long, lens binary, ids binary"


def _byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes as the tokenizers library does with a byte-level BPE file, without truncation, padding or added specials."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec, alphabet = json.loads(text), _byte_alphabet()
        self.slow = Tokenizer.from_str(text)
        self.slow.no_truncation()
        self.slow.no_padding()
        vocab, merges = spec["model"]["vocab"], [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        of_bytes = {}
        for token, k in vocab.items():
            if token not in self.special:
                of_bytes[bytes(alphabet[c] for c in token)] = k
        pre = spec["pre_tokenizer"] or {}
        in_order = [vocab[a + b] for a, b in merges]
        plain = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        #: whether the places of Chunks are agreed; other files have no chunks, and texts are encoded whole
        self.chunked = plain
        self.fast = None
        if plain and in_order == sorted(in_order) and not spec["model"].get("ignore_merges"):
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=of_bytes, special_tokens={})
        size = max([*of_bytes.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for piece, k in [*of_bytes.items(), *((c.encode(), k) for c, k in self.special.items())]:
            pieces[k] = piece
        self.lens = np.array([len(p) for p in pieces])
        self.sizes = self.lens.tolist()
        self.at = np.cumsum(self.lens) - self.lens
        self.all = np.frombuffer(b"".join(pieces), np.uint8)

    def encode(self, data: bytes) -> list[int]:
        if not data:
            return []
        text = data.decode("utf-8", "replace")
        # the slow way for special tokens, and for scripts where the two libraries' Unicode tables may differ
        if self.fast is None or max(data) >= 0xE0 or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.lens[ids]
        to = np.cumsum(size)
        return self.all[np.repeat(self.at[ids] - (to - size), size) + np.arange(int(to[-1]))].tobytes()


    def head(self, ids: list[int], size: int) -> list[int] | None:
        """The first ids, which stand for ``size`` bytes; None if a token stands across."""
        n, have = 0, 0
        while have < size and n < len(ids):
            have += self.sizes[ids[n]]
            n += 1
        return ids[:n] if have == size else None

    def tail(self, ids: list[int], size: int) -> list[int] | None:
        n, have = len(ids), 0
        while have < size and n:
            n -= 1
            have += self.sizes[ids[n]]
        return ids[n:] if have == size else None


_codecs: dict[int, Codec] = {}


def _codec(text: str) -> Codec:
    if hash(text) not in _codecs:
        _codecs[hash(text)] = Codec(text)
    return _codecs[hash(text)]


class Chunks:
    """Content-defined chunks of a pack's documents.

    A place where encodings should agree has one space between two visible ASCII characters: a
    pre-token of the pattern begins there, whatever stands around. A chunk's inside runs from its
    first to its last such place and is encoded alone; what lies between the insides of
    two chunks is the join.
    """

    def __init__(self, pack: C.Pack, chunked: bool):
        buf, off = pack.buf, pack.offsets
        n = len(buf)
        cut = np.zeros(n + 1, bool)
        if n > ROLL:
            rolled = C.run_hashes(buf, ROLL)[: n - ROLL]
            cut[ROLL:n] = rolled >> np.uint64(64 - CUT_BITS) == 0
            cut[1:] &= ~cut[:-1]
        cut[off] = True
        space = np.flatnonzero(buf == 0x20)
        space = space[(space > 0) & (space < n - 1)]
        visible = lambda x: (x > 0x20) & (x < 0x7F)
        space = space[visible(buf[space - 1]) & visible(buf[space + 1])]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        safe = space[~edge[space] & ~edge[space + 1]]
        at = np.flatnonzero(cut)
        lo, hi = np.searchsorted(safe, at[:-1]), np.searchsorted(safe, at[1:])
        use = (hi - lo >= 4) & chunked
        lo, hi = lo[use], hi[use]
        self.start, self.end = safe[lo], safe[hi - 1]
        self.safe, self.lo, self.hi = safe, lo, hi
        self.key = C.bytes_hashes(buf, self.start, self.end)
        self.doc = np.searchsorted(off, self.start, side="right") - 1
        long = self.end - self.start >= LEAST
        self.distinct, first, self.which = np.unique(self.key, return_index=True, return_inverse=True)
        self.long = long[first] if len(first) else long
        self.sample = first

    def sent(self) -> np.ndarray:
        """The distinct keys worth an exchange, sorted."""
        return np.flatnonzero(self.long)


def joined(codec: Codec, chunks: Chunks, known: list, data: bytes, off: np.ndarray) -> list[list[int]]:
    """Ids of each document: its chunks', with the joins encoded anew until both sides agree.

    A join is encoded together with a piece of the chunk on either side, up to a place further in. If the
    result is the chunks' own ids there, with the join's between, it stands; else the pieces grow, at last to the whole text.
    """
    out, first = [], np.searchsorted(chunks.doc, np.arange(len(off)))

    def ids_of(c):
        w = chunks.which[c]
        if known[w] is None:
            known[w] = codec.encode(data[chunks.start[c] : chunks.end[c]])
        return known[w]

    for d in range(len(off) - 1):
        lo, hi, ids, whole = int(off[d]), int(off[d + 1]), [], True
        some, at = range(first[d], first[d + 1]), lo
        for c in [*some, None]:
            to = hi if c is None else int(chunks.start[c])
            join = codec.encode(data[at:to])
            before = c - 1 if c is not None and c > first[d] else first[d + 1] - 1 if c is None and len(some) else None
            if not _agrees(codec, chunks, ids_of, data, before, c, at, to, join):
                whole = False
                break
            ids += join
            if c is not None:
                ids += ids_of(c)
                at = int(chunks.end[c])
        out.append(ids if whole else codec.encode(data[lo:hi]))
    return out


def _agrees(codec, chunks, ids_of, data: bytes, before, after, at: int, to: int, join: list[int]) -> bool:
    """Whether encoding the join with more and more of its chunks gives the ids that both have."""
    for step in (1, 2, 4, 8):
        left, right, a, b = [], [], at, to
        if before is not None:
            a = int(chunks.safe[max(chunks.hi[before] - 1 - step, chunks.lo[before])])
            left = codec.tail(ids_of(before), at - a)
        if after is not None:
            b = int(chunks.safe[min(chunks.lo[after] + step, chunks.hi[after] - 1)])
            right = codec.head(ids_of(after), b - to)
        if left is not None and right is not None and codec.encode(data[a:b]) == left + join + right:
            return True
    return False


ALONE, OWN, AWAIT = 0, 1, 2


def _owner(keys, who, extras):
    """The first pack of a key encodes it for all."""
    order = np.lexsort((who, keys))
    cut = C.group_starts(keys[order])
    count = np.diff(np.append(np.flatnonzero(cut), len(keys)))[np.cumsum(cut) - 1]
    out = np.empty(len(keys), np.uint8)
    out[order] = np.where(count == 1, ALONE, np.where(cut, OWN, AWAIT))
    return out


def _encoded(docs: DataFrame, tokenizer: str, text: str, key: str, carry: list[str], schema: str, emit) -> DataFrame:
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        file = f.read()
    model, chunked = spark.sparkContext.broadcast(file), Codec(file).chunked
    packs = C.packed(docs, text, key, carry, level=9)
    nb = C.buckets_for(packs, 1 / 16)  # a bucket holds its chunks' ids, too
    light = packs.drop("rest", "rest_lens", "also")

    def digests(batches):
        for row in C.rows_of(batches):
            chunks = Chunks(C.Pack(row), chunked)
            keys = chunks.distinct[chunks.sent()]
            if (out := C.entries(row["pack_id"], keys, [np.zeros(len(keys), np.uint8)], nb)) is not None:
                yield out

    answers = C.answered(light.mapInArrow(C.tidied(digests), C.ENTRY_SCHEMA), [np.uint8], _owner)

    def post(batches):
        """Owners post their chunks' ids; others ask for them."""
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for row in C.rows_of(batches):
            answer = C.answer_bytes(row["answers"])
            if not answer.any():
                continue
            codec, pack = _codec(model.value), C.Pack(row)
            chunks = Chunks(pack, chunked)
            sent = chunks.sent()
            out = []
            for role in (OWN, AWAIT):
                k = sent[answer == role]
                keys = chunks.distinct[k]
                cuts = np.searchsorted(C.bucket_of(keys, nb), np.arange(nb + 1, dtype=np.uint64))
                for b in np.flatnonzero(np.diff(cuts)):
                    some = slice(cuts[b], cuts[b + 1])
                    lens, ids = b"", b""
                    if role == OWN:
                        lists = [codec.encode(pack.buf[chunks.start[s] : chunks.end[s]].tobytes()) for s in chunks.sample[k[some]]]
                        lens = np.array([len(x) for x in lists], np.int32).tobytes()
                        ids = press.compress(np.array([i for x in lists for i in x], np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes())
                    out.append([int(b), row["pack_id"], role == AWAIT, len(keys[some]), keys[some].tobytes(), lens, ids])
            yield C.batch_of(POST_SCHEMA, [list(c) for c in zip(*out, strict=True)])

    def unpressed(lens, ids):
        import zstandard

        n = np.frombuffer(lens, np.int32)
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8) if ids else np.zeros(0, np.uint8)
        return n, np.ascontiguousarray(raw.reshape(4, -1).T).view(np.uint32).reshape(-1)

    def give(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        rows = list(C.rows_of(batches))
        posted = [r for r in rows if not r["asks"]]
        opened = [unpressed(r["lens"], r["ids"]) for r in posted]
        if not opened:
            return
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in posted])
        lens, ids = np.concatenate([x[0] for x in opened]), np.concatenate([x[1] for x in opened])
        begin = np.cumsum(lens) - lens
        order = np.argsort(keys)
        ranked = keys[order]
        for r in rows:
            if r["asks"]:
                k = order[np.searchsorted(ranked, np.frombuffer(r["keys"], np.uint64))]
                n = lens[k].astype(np.int64)
                at = np.repeat(begin[k] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield C.batch_of(GIVE_SCHEMA, [[r["bucket"]], [r["pack_id"]], [lens[k].astype(np.int32).tobytes()], [press.compress(ids[at].view(np.uint8).reshape(-1, 4).T.tobytes())]])

    posted = light.join(answers.hint("merge"), "pack_id").mapInArrow(C.tidied(post), POST_SCHEMA)
    given = posted.groupBy("bucket").applyInArrow(C.per_group(give), GIVE_SCHEMA)
    given = C.written(given.groupBy("pack_id").agg(F.sort_array(F.collect_list(F.struct("bucket", "lens", "ids"))).alias("given")))

    def last(batches):
        for row in C.rows_of(batches):
            codec, pack = _codec(model.value), C.Pack(row)
            chunks = Chunks(pack, codec.chunked)
            known: list = [None] * len(chunks.distinct)
            sent, answer = chunks.sent(), C.answer_bytes(row["answers"])
            data = pack.buf.tobytes()
            if row["given"]:
                got = iter(sent[answer == AWAIT])
                for x in row["given"]:
                    lens, ids = unpressed(x["lens"], x["ids"])
                    ends = np.cumsum(lens)
                    for lo, hi in zip(ends - lens, ends, strict=True):
                        w = next(got)
                        c = chunks.sample[w]
                        # equal digests are confirmed: ids that decode to these bytes are theirs
                        if codec.decode(ids[lo:hi]) == data[chunks.start[c] : chunks.end[c]]:
                            known[w] = ids[lo:hi].tolist()
            yield emit(codec, pack, joined(codec, chunks, known, data, pack.offsets))

    known = answers.join(given.hint("merge"), "pack_id", "left")
    return packs.join(known.hint("merge"), "pack_id", "left").mapInArrow(C.tidied(last), schema)


def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", carry: list[str] = ()) -> DataFrame:
    """Token ids of every whole text, and the text that they decode to.

    tokenizer: the path, on the driver, of a byte-level BPE file of the tokenizers library.
    Texts are cut into chunks by a rolling hash. Chunks that several packs of documents have
    are encoded once, by one of them, and the ids are sent to the others, which check that they
    decode to their own bytes; within a pack a repeated chunk is encoded once. Joins of chunks
    are encoded anew with more and more of the chunks on both sides until the ids agree. The ids
    are those of encoding the whole text at once. A file with a normaliser, a leading space or
    another pattern has no places that are sure to agree: its texts are encoded whole.

    A null text counts as empty: no ids, an empty decoded text. Repeated rows and null ids come
    back as they are; other columns play no part. An empty table gives no rows.
    Returns doc_id, ids, decoded and rest (JSON of the carried columns).
    """

    def emit(codec, pack, lists):
        flat = np.array([i for x in lists for i in x], np.int32)
        ends = np.cumsum([0, *(len(x) for x in lists)])
        decoded = [codec.decode(flat[lo:hi].astype(np.int64)).decode("utf-8", "replace") for lo, hi in zip(ends, ends[1:])]
        return C.batch_of(OUT_SCHEMA, [pack.id_column(), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), decoded, pack.rest()])

    return _encoded(docs, tokenizer, text, key, carry, OUT_SCHEMA, emit)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_encode(C.table(spark, sf_dir, "documents"), default_tokenizer())
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
