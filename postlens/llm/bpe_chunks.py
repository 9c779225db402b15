"""BPE encoding and decoding with content-defined chunk reuse.

A gear rolling hash over the bytes cuts texts where its low bits are zero, so equal
passages of different documents fall into equal chunks.  Chunks that occur more than
once are counted over the whole corpus; the ones that save most (``MAX_SHARED``) are
encoded once and sent to every task as a dictionary of bounded size.  A document's
ids are the ids of its dictionary chunks with the stretches between them, and all
other chunks, encoded in place.

Joins.  A *sync point* is a space between two characters that are no white space: the
pre-tokeniser always splits there, whatever lies on either side, and merges never
cross it.  A chunk's reusable core runs from its first to its last sync point; what
lies around a chunk join, from the core before it to the core after, is re-encoded as
one piece.  Finally the ids are decoded and compared with the text; a document that
does not agree (a hash collision) is encoded afresh as a whole, so results are exact.
In-place encoding remembers the ids of pieces between sync points, within bounds.

Defined results: a null text counts as empty: no ids, the hashes of no bytes; strings
that look like special tokens become them, as in the library; repeated rows give
repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .cluster import checkpointed, released, ship, trim

CHUNK_BITS = 9        # chunks of about 2**CHUNK_BITS bytes
MAX_SHARED = 1 << 15  # chunks in the dictionary, about 8 MB of ids
MAX_SHARED_BYTES = 1 << 14  # a longer core is encoded in place
MEMO_BYTES = 24 << 20  # of the remembered pieces of a task and their ids, as Python objects
VOCABULARY = "byte_bpe_50k.json"

_GEAR = ta.mix64(np.arange(256, dtype=np.uint64) + np.uint64(77)).astype(np.uint32)

# Bytes after and before a space that cannot belong to white space: ASCII but controls,
# and lead bytes of characters in blocks without white space.
_NEXT = np.zeros(256, dtype=bool)
_NEXT[0x21:0x7F] = _NEXT[0xC3:0xE0] = _NEXT[0xE4:0xF5] = True
_ASCII = np.zeros(256, dtype=bool)
_ASCII[0x21:0x7F] = True


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct values of both, ascending."""
    x = np.sort(np.concatenate([a, b]), kind="stable")
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def chunk_cuts(buf: np.ndarray, offsets: np.ndarray, bits: int = CHUNK_BITS) -> np.ndarray:
    """Positions after which a chunk ends, by the rolling hash of the last 32 bytes."""
    h = _GEAR[buf]
    for k in range(5):  # h[i] = sum of gear[buf[i - j]] << j, j < 32
        step = 1 << k
        h[step:] += h[:-step] << np.uint32(step)
    return _merged(np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + 1, offsets[offsets > 0])


def sync_points(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions of spaces where encodings can be joined exactly."""
    at = np.flatnonzero(buf == 0x20)
    at = at[(at > 0) & (at + 1 < len(buf))]
    p1 = buf[at - 1]
    p2, p3 = buf[np.maximum(at - 2, 0)], buf[np.maximum(at - 3, 0)]
    tail = (p1 & 0xC0) == 0x80
    before = _ASCII[p1] | (tail & (p2 >= 0xC3) & (p2 < 0xE0)) | (tail & ((p2 & 0xC0) == 0x80) & (p3 >= 0xE4) & (p3 < 0xF0))
    at = at[before & _NEXT[buf[at + 1]]]
    inner = np.searchsorted(offsets, at, "right") - 1
    return at[(at > offsets[inner]) & (at + 1 < offsets[inner + 1])]


def cores(buf: np.ndarray, offsets: np.ndarray, sync: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the reusable core of each chunk that has one."""
    cuts = chunk_cuts(buf, offsets)
    starts = np.concatenate([[0], cuts[:-1]]) if len(cuts) else np.zeros(0, np.int64)
    first = np.searchsorted(sync, starts)
    last = np.searchsorted(sync, cuts, "left") - 1
    ok = last > first
    lo, hi = sync[first[ok]], sync[last[ok]]
    short = hi - lo <= MAX_SHARED_BYTES
    return lo[short], hi[short]


def _joinable(x: bytes) -> bool:
    """Whether pieces before and after ``x`` join it at sync points."""
    if len(x) < 2 or x[0] != 0x20 or not _NEXT[x[1]]:
        return False
    end = x[-1]
    return bool(_ASCII[end]) or end >= 0x80 and 0xC3 <= x[-2] < 0xE0


def _kept(piece: bytes, ids: bytes) -> int:
    """Bytes of an entry of the memo: two objects, their headers, and its place."""
    return len(piece) + len(ids) + 130


class Codec:
    """Tokenizer and id table of a worker process."""

    _have: dict[str, "Codec"] = {}

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = [b for b in range(256) if b not in set(kept)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(other)}
        model = json.loads(spec)
        self.table = [b""] * (1 + max([*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])]))
        for token, i in model["model"]["vocab"].items():
            self.table[i] = bytes(byte_of[c] for c in token)
        for t in model["added_tokens"]:
            self.table[t["id"]] = t["content"].encode()
        self.lengths = np.array([len(x) for x in self.table], dtype=np.int64)
        self.memo: dict[bytes, bytes] = {}
        self.memo_bytes = 0

    @classmethod
    def get(cls, spec: str) -> "Codec":
        key = hashlib.sha256(spec.encode()).hexdigest()
        if key not in cls._have:
            cls._have[key] = cls(spec)
            trim()  # what parsing took
        return cls._have[key]

    def direct(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def packed(self, ids: bytes) -> bytes:
        """Ids as 16-bit numbers where the vocabulary allows it."""
        return np.frombuffer(ids, dtype="<u4").astype("<u2").tobytes() if len(self.table) <= 1 << 16 else ids

    def unpacked(self, ids: bytes) -> bytes:
        return np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes() if len(self.table) <= 1 << 16 else ids

    def joined(self, pieces: list[bytes]) -> list[bytes]:
        """Like ``direct`` for pieces that can be joined at sync points: one text, one call."""
        found = self.tokenizer.encode_batch_fast([b"".join(pieces).decode()], add_special_tokens=False)[0]
        ids = np.array(found.ids, dtype="<u4")
        ends = np.cumsum(self.lengths[ids])
        at = np.searchsorted(ends, np.cumsum([len(x) for x in pieces]), "left") + 1
        raw, last, out = ids.tobytes(), 0, []
        for k in (4 * at).tolist():
            out.append(raw[last:k])
            last = k
        return out

    def learn(self, pieces: list[bytes]) -> None:
        """Make sure that every piece has its ids in the memo."""
        needed = set(pieces)
        new = needed.difference(self.memo)
        if self.memo_bytes > MEMO_BYTES:
            # The pieces met first are the most frequent ones: they stay.  No second dictionary is made.
            for x in list(islice(reversed(self.memo), len(self.memo) // 2)):
                self.memo_bytes -= _kept(x, self.memo.pop(x))
            new = needed.difference(self.memo)
        plain, odd = [], []
        for x in new:
            (plain if _joinable(x) else odd).append(x)
        for lo in range(0, len(plain), 512):
            part = plain[lo:lo + 512]
            self.remember(part, self.joined(part))
        for lo in range(0, len(odd), 512):
            part = odd[lo:lo + 512]
            self.remember(part, self.direct(part))

    def remember(self, pieces: list[bytes], ids: list[bytes]) -> None:
        self.memo.update(zip(pieces, ids))
        self.memo_bytes += sum(map(_kept, pieces, ids))

    def forget(self) -> None:
        self.memo, self.memo_bytes = {}, 0

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def encode_slice(codec: Codec, s: ta.Slice, shared: dict[bytes, bytes]) -> list[tuple[bytes, bytes]]:
    """Ids (little-endian unsigned 32-bit) and decoded bytes of every text of a slice."""
    raw = s.buf.tobytes()
    sync = sync_points(s.buf, s.offsets)
    borders = _merged(sync, s.offsets)
    skip: dict[int, tuple[int, bytes]] = {}  # border of a dictionary core -> the border behind it and its ids
    if shared:
        lo, hi = cores(s.buf, s.offsets, sync)
        place = np.searchsorted(borders, lo).tolist()
        behind = np.searchsorted(borders, hi).tolist()
        for a, b, p, q in zip(lo.tolist(), hi.tolist(), place, behind):
            ids = shared.get(xxhash.xxh3_128_digest(raw[a:b]))
            if ids is not None:
                skip[p] = (q, codec.unpacked(ids))
    at = borders.tolist()
    first = np.searchsorted(borders, s.offsets).tolist()
    runs: list[list[bytes | list[bytes]]] = []
    pieces: list[bytes] = []
    for i in range(len(s.offsets) - 1):
        run: list[bytes | list[bytes]] = []
        k, end = first[i], first[i + 1]
        stops = [p for p in range(k, end) if p in skip] if skip else []
        for p in stops:
            if p < k:
                continue
            own = [raw[a:b] for a, b in zip(at[k:p], at[k + 1:p + 1])]
            pieces += own
            run += [own, skip[p][1]]
            k = skip[p][0]
        own = [raw[a:b] for a, b in zip(at[k:end], at[k + 1:end + 1])]
        pieces += own
        run.append(own)
        runs.append(run)
    codec.learn(pieces)
    get = codec.memo.__getitem__
    out = []
    for i, run in enumerate(runs):
        ids = b"".join(x if isinstance(x, bytes) else b"".join(map(get, x)) for x in run)
        text = raw[s.offsets[i]:s.offsets[i + 1]]
        decoded = codec.decode(ids)
        if decoded != text:  # a collision of chunk hashes
            ids = codec.direct([text])[0]
            decoded = codec.decode(ids)
        out.append((ids, decoded))
    return out


def shared_chunks(docs: DataFrame, spec, max_shared: int = MAX_SHARED) -> dict[bytes, bytes]:
    """Hash -> packed ids of the repeated chunk cores that save most bytes; each encoded once."""
    rows = docs.select(F.col("text").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in ta.slices(b.column(0)):
                raw = s.buf.tobytes()
                lo, hi = cores(s.buf, s.offsets, sync_points(s.buf, s.offsets))
                keys = [xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(lo.tolist(), hi.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array((hi - lo).astype(np.int32))], names=["h", "n"])

    seen = rows.mapInArrow(released(count), "h binary, n int").groupBy("h").agg(F.count("*").alias("times"), F.first("n").alias("n")).where("times > 1")
    # Eighths of an octave of the bytes saved; the best of them that hold max_shared chunks at most.
    seen = checkpointed(seen.select("h", F.floor(8 * F.log2(F.col("n") * (F.col("times") - 1))).alias("step")))
    least, room = None, max_shared
    for r in sorted(seen.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    best = {bytes(r["h"]) for r in seen.where(F.col("step") >= least).select("h").collect()} if least is not None else set()
    if not best:
        return {}
    wanted = docs.sparkSession.sparkContext.broadcast(best)  # at most max_shared hashes of 16 bytes

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            for s in ta.slices(b.column(0)):
                raw = s.buf.tobytes()
                found = {}
                for a, z in zip(*(x.tolist() for x in cores(s.buf, s.offsets, sync_points(s.buf, s.offsets)))):
                    h = xxhash.xxh3_128_digest(raw[a:z])
                    if h in wanted.value and h not in sent:
                        found[h] = raw[a:z]
                sent |= found.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["h", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.get(spec.value)
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                part = b.slice(lo, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([codec.packed(x) for x in codec.direct(part.column(1).to_pylist())], pa.binary())], names=["h", "ids"])

    once = rows.mapInArrow(released(texts), "h binary, text binary").groupBy("h").agg(F.min("text").alias("text"))
    return {bytes(r["h"]): bytes(r["ids"]) for r in once.mapInArrow(released(encode), "h binary, ids binary").collect()}


def vocabulary(path: str | None = None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded_batches(batches: Iterator[pa.RecordBatch], codec: Codec, shared: dict[bytes, bytes], columns: list) -> Iterator[pa.RecordBatch]:
    """Batches of doc_id and ``columns`` from those of doc_id and text, a slice at a time.  A batch
    is given up before the next one is asked for."""
    try:
        for b in batches:
            for s in ta.slices(b.column(1)):
                done = encode_slice(codec, s, shared)
                out = [pa.array([f(ids, text) for ids, text in done], kind) for _, _, kind, f in columns]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(done)), *out], names=["doc_id", *(name for name, _, _, _ in columns)])
                del s, done, out
            del b
    finally:
        codec.forget()  # the worker process lives on in other stages


def encode(docs: DataFrame, path: str | None = None, max_shared: int = MAX_SHARED) -> DataFrame:
    """doc_id, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded`` of every text."""
    return _encoded(docs, path, max_shared, [("ids", T.BinaryType(), pa.binary(), lambda ids, text: ids),
                                             ("decoded", T.StringType(), pa.string(), lambda ids, text: text.decode("utf-8", "replace"))])


def _encoded(docs: DataFrame, path: str | None, max_shared: int, columns: list) -> DataFrame:
    """doc_id and ``columns``: (name, type, Arrow type, function of the ids and the decoded bytes)."""
    spark = docs.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(vocabulary(path))
    shared = spark.sparkContext.broadcast(shared_chunks(docs, spec, max_shared))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(name, kind) for name, kind, _, _ in columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded_batches(batches, Codec.get(spec.value), shared.value, columns)

    return rows.mapInArrow(released(run), schema)


def digests(docs: DataFrame, path: str | None = None, max_shared: int = MAX_SHARED) -> DataFrame:
    return _encoded(docs, path, max_shared, [
        ("n_tokens", T.LongType(), pa.int64(), lambda ids, text: len(ids) // 4),
        ("ids_sha256", T.StringType(), pa.string(), lambda ids, text: hashlib.sha256(ids).hexdigest()),
        ("decoded_sha256", T.StringType(), pa.string(), lambda ids, text: hashlib.sha256(text).hexdigest())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests(docs)
