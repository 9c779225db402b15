"""Substring dedup: compact windows of token min-hashes, interval joins, verification.

Tokens of a text are its shingles of ``WIDTH`` words.  For each of ``HASHES`` hash
functions the Cartesian tree over the token hashes gives the compact windows: node c
with the widest interval [l, r] in which it is the minimum stands for all subsequences
of [l, r] through c, which share their min-hash; only windows of ``MIN_TOKENS`` or more
are kept (about 2n / MIN_TOKENS of n).  Windows of equal min-hash in two documents
overlap in an interval around their minima, on the diagonal of the offset; pairs of
documents whose intervals come from enough (``ENOUGH``) hash functions on one band of
diagonals are candidates.  Candidates are verified token by token: spans that begin and
end with a shared token, reach ``PERCENT`` per cent Jaccard and ``MIN_WORDS`` words.

Each document is compared with the first document (smallest id) of each of its
min-hashes and with the one before it; copies met within a task are linked there to the
first of the task and only that one is dealt out by its hash, so a passage that a third
of all documents share does not meet in one task.  Min-hashes of three or more documents
are compared further, by the min-hash with the ``HALF`` tokens to its left or right: any
common passage of ``MIN_WORDS`` words holds one side of its minimum.  Windows with the
same ``REACH`` tokens to each side of the minimum form a class, which its first document
stands for, and the classes of a key meet pairwise in blocks.  There a class is a candidate with an earlier one if they share a
span as above near the minimum that no earlier one met in the block has already covered,
so a common passage does not expand into its pairs.  The first document keeps a passage,
later ones lose it.

Defined results: null, empty and short texts have no windows and are never changed;
rows alike in id and text are one document, rows that share only the id are different
ones; a null id counts as larger than all others; repeats inside one document alone are
not reported; an empty table gives no rows; extra columns pass through the stage.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textarrays as ta
from .cluster import delete, new_folder, released, ship, written

WIDTH = 5
MIN_WORDS = 50
MIN_TOKENS = MIN_WORDS - WIDTH + 1
HASHES = 4
ENOUGH = 2
PERCENT = 80
BAND = 16            # diagonals of a band
TILE = 64            # tokens of a verified tile; one bit each in a long
REACH = MIN_TOKENS - 1  # of a strip, to each side of a minimum
HALF = MIN_TOKENS // 2  # of a side that documents share with the minimum
BLOCK = 4096         # classes of a block
WORDS = 1 << 19      # of 64 bits, compared at a time
TURNS = 8            # heads that rows meet together; those not done go on one by one ...
FEW = 16             # ... and so do rows fewer than these
MANY = 512           # classes from which on the diagonals of all alike windows of a document count
BUFFER_ROWS = 150_000
LAST_ID = (1 << 63) - 1  # stands for a null id

_U = np.uint64
_SEEDS = ta.mix64(np.arange(1, 65, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def tokens(s: ta.Slice, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of the texts of a slice, A-Z lower-cased, and their ptr."""
    w = ta.words(s.buf, s.offsets)
    return ta.windows(ta.span_hashes(s.buf, w.starts, w.ends, lower=True), w.ptr, width)


def compact_windows(f: np.ndarray, ptr: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, first and last position of every window of ``least`` or more positions.

    ``f``: hashes of all texts; ties go to the left.  Nodes of the Cartesian tree with so
    large an interval are the minima of the runs of ``least`` positions; their nearest
    smaller neighbours are their ancestors, hence such nodes too.
    """
    n = len(f)
    ends = np.repeat(ptr[1:], np.diff(ptr))
    at = np.arange(n)
    valid = at + least <= ends
    if not valid.any():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    bits = int(n).bit_length()
    order = (f >> _U(bits) << _U(bits)) | at.astype(_U)
    low, span = order, 1
    while 2 * span <= least:
        low = np.minimum(low[:-span], low[span:]) if len(low) > span else low
        span *= 2
    low = np.minimum(low[:n - least + 1], low[least - span:least - span + n - least + 1])
    centre = (low & _U((1 << bits) - 1)).astype(np.int64)[valid[:len(low)]]
    centre = centre[np.append(True, centre[1:] != centre[:-1])]
    values = order[centre]
    text = np.searchsorted(ptr, centre, "right") - 1
    left, right = nearest_smaller(values, text), len(values) - 1 - nearest_smaller(values[::-1], text[::-1])[::-1]
    first = np.where(left < 0, ptr[text], centre[left] + 1)
    last = np.where(right == len(values), ptr[text + 1], centre[np.minimum(right, len(values) - 1)]) - 1
    return centre, first, last


def nearest_smaller(values: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each of distinct values the place of the nearest smaller one to its left in its text, or -1.

    All between a place and the one it points to are larger than it, so it may go on to
    where that one points; ways double, and most places are done after a few steps.
    """
    left = np.arange(-1, len(values) - 1)
    left[changed(text)] = -1
    open_ = np.flatnonzero(left >= 0)
    while len(open_):
        to = left[open_]
        on = values[to] > values[open_]
        open_ = open_[on]
        left[open_] = left[to[on]]
        open_ = open_[left[open_] >= 0]
    return left


_OWN = T.StructType([T.StructField("id", T.LongType()), T.StructField("h", T.IntegerType()), T.StructField("c", T.IntegerType()),
                     T.StructField("l", T.IntegerType()), T.StructField("r", T.IntegerType())])
_WINDOW = T.StructType([T.StructField("key", T.LongType()), T.StructField("i", T.IntegerType()), *_OWN.fields, T.StructField("own", _OWN),
                        T.StructField("minhash", T.LongType())])  # minhash: the key before it is changed for a linked window


def keyed(docs: DataFrame) -> DataFrame:
    """id (null last), h (of the text) and text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
                       F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int").alias("h"), F.col("text").cast("string").alias("text"))


def windows(rows: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Compact windows with the key of their min-hash.  Of windows that a task finds with
    one key, the first document's is dealt by the key; the others carry it as ``own``."""

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = [np.concatenate(x) for x in zip(*parts)]
        key, _, id_, h, c, _, _ = cols
        n = len(key)
        by = np.lexsort((c, h, id_, key))
        start = np.append(True, key[by][1:] != key[by][:-1])
        first = np.empty(n, dtype=np.int64)   # the first window of each one's key ...
        first[by] = by[np.flatnonzero(start)[np.cumsum(start) - 1]]
        before = np.empty(n, dtype=np.int64)  # ... and the one before it
        before[by] = np.where(start, by, np.roll(by, 1))
        other = lambda x: (id_ != id_[x]) | (h != h[x])
        linked = other(first)
        # Rows stay in the order of the texts, in which ids compress well.  A linked window
        # also gets a row for the one before it, if that is of yet another document.
        again = np.flatnonzero(linked & (before != first) & other(before))
        rows = np.concatenate([np.arange(n), again])
        owner = np.concatenate([first, before[again]])
        linked = np.concatenate([linked, np.ones(len(again), dtype=bool)])
        cols = [x[rows] for x in cols]
        minhash = pa.array(cols[0])
        cols[0] = np.where(linked, ta.as_int64(ta.mix64(cols[0].view(np.uint64) + np.arange(len(rows), dtype=np.uint64))), cols[0])
        own = pa.StructArray.from_arrays([pa.array(np.concatenate(x)[owner]) for k, x in enumerate(zip(*parts)) if k > 1], names=_OWN.names, mask=pa.array(~linked))
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in cols), own, minhash], names=_WINDOW.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in ta.slices(b.column(2)):
                g, ptr = tokens(s)
                for i in range(hashes):
                    f = ta.mix64(g ^ _SEEDS[i])
                    c, l, r = compact_windows(f, ptr, MIN_TOKENS)
                    if not len(c):
                        continue
                    text = np.searchsorted(ptr, c, "right") - 1
                    base = ptr[text]
                    parts.append((ta.as_int64(f[c]), np.full(len(c), i, np.int32), ids[s.first + text], hs[s.first + text],
                                  *((x - base).astype(np.int32) for x in (c, l, r))))
                    held += len(c)
                if held >= BUFFER_ROWS:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return rows.mapInArrow(released(run), _WINDOW)


def met_windows(rows: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Windows that meet others of their min-hash: with ``own``, or with the first and the previous one."""
    me = F.struct("id", "h", "c", "l", "r")
    group = Window.partitionBy("key").orderBy("id", "h", "c")
    upto = group.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (windows(rows, hashes).withColumn("first", F.first(me).over(upto)).withColumn("before", F.lag(me).over(group))
            .where("own is not null or before is not null"))


def candidates(found: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(id, h, oid, oh, band, dlo, dhi, first, last): token interval of a document whose
    windows meet those of an earlier document on a band of diagonals."""
    owners = F.when(F.col("own").isNotNull(), F.array("own")).otherwise(F.array_distinct(F.array("first", "before")))
    linked = (found.withColumn("own", F.explode(owners))
              .where((F.col("id") != F.col("own.id")) | (F.col("h") != F.col("own.h"))))
    diag = F.col("c") - F.col("own.c")
    lo = F.greatest(F.col("l"), F.col("own.l") + diag)
    hi = F.least(F.col("r"), F.col("own.r") + diag)
    met = linked.select("i", "id", "h", F.col("own.id").alias("oid"), F.col("own.h").alias("oh"), diag.alias("d"), lo.alias("lo"), hi.alias("hi"))
    met = met.where(F.col("hi") - F.col("lo") + 1 >= MIN_TOKENS)
    return (met.groupBy("id", "h", "oid", "oh", F.floor(F.col("d") / BAND).alias("band"))
            .agg(F.bit_or(F.pow(F.lit(2), F.col("i")).cast("int")).alias("which"),
                 F.min("d").alias("dlo"), F.max("d").alias("dhi"), F.min("lo").alias("first"), F.max("hi").alias("last"))
            .where(F.bit_count("which") >= enough).drop("which"))


def crowded(found: DataFrame) -> DataFrame:
    """(minhash, id, h, c): windows of the min-hashes of three or more windows, not all of one document."""
    members = found.select("minhash", F.explode(F.array(
        *(F.struct(*(F.col(f"{s}{c}").alias(c) for c in ("id", "h", "c"))) for s in ("", "own.", "first.")))).alias("m"))
    members = members.select("minhash", "m.*").where("id is not null").distinct()
    group, doc = Window.partitionBy("minhash"), F.struct("id", "h")
    return (members.withColumn("n", F.count("*").over(group)).withColumn("d0", F.min(doc).over(group)).withColumn("d1", F.max(doc).over(group))
            .where("n > 2 and d0 <> d1").select("minhash", "id", "h", "c"))


class Places(NamedTuple):
    row: np.ndarray     # of the batch
    at: np.ndarray      # token of the slice
    low: np.ndarray     # first token of its text
    high: np.ndarray    # one past its last
    rest: list          # the lists' other fields


def places(s: ta.Slice, ptr: np.ndarray, lists: pa.ListArray) -> Places:
    """The tokens that ``lists`` (of structs, c first) ask for in the texts of a slice."""
    own = lists.slice(s.first, len(ptr) - 1)
    t = np.repeat(np.arange(len(ptr) - 1), own.value_lengths().to_numpy())
    c, *rest = (x.to_numpy() for x in own.flatten().flatten())
    at = ptr[t] + c
    inside = at < ptr[t + 1]
    t = t[inside]
    return Places(s.first + t, at[inside], ptr[t], ptr[t + 1], [x[inside] for x in rest])


def around(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, id, h, c, at, n, cls): a strip has the 16-bit hashes of the n tokens within REACH of c;
    at: of c in it; cls: a hash of at and strip.  One row for each side of c that has HALF tokens,
    its key made of them and the min-hash.  Strips themselves are not kept, see ``class_strips``."""
    lists = wanted.groupBy("id", "h").agg(F.collect_set(F.struct("c", "minhash")).alias("centres"))  # at most a text's windows
    asked = rows.join(lists, ["id", "h"]).select("id", "h", "text", "centres")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in ta.slices(b.column(2)):
                g, ptr = tokens(s)
                p = places(s, ptr, b.column(3))
                begin, end = np.maximum(p.low, p.at - REACH), np.minimum(p.high, p.at + REACH + 1)
                cls = ta.mix64(ta.run_hashes((g >> _U(11)).astype(np.uint16).astype(_U), begin, end) ^ ta.mix64(p.at - begin))
                minhash = p.rest[0].view(_U)
                parts = []
                for side, (lo, hi) in enumerate(((p.at - HALF, p.at), (p.at, p.at + HALF))):
                    ok = np.flatnonzero((lo >= p.low) & (hi < p.high))
                    key = ta.mix64(ta.run_hashes(g, lo[ok], hi[ok] + 1) ^ ta.mix64(minhash[ok] + _U(side)))
                    k = p.row[ok]
                    parts.append((ta.as_int64(key), ids[k], hs[k], (p.at - p.low)[ok].astype(np.int32), (p.at - begin)[ok].astype(np.int32),
                                  (end - begin)[ok].astype(np.int32), ta.as_int64(cls[ok])))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts)], names=["key", "id", "h", "c", "at", "n", "cls"])

    return asked.mapInArrow(released(run), "key long, id long, h int, c int, at int, n int, cls long")


def class_strips(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``classes`` (as of ``several``) with at and the strip of their first windows, made from the texts again."""
    lists = classes.groupBy("id", "h").agg(F.collect_list(F.struct("c", "key", "own", "n")).alias("centres"))  # at most a text's windows
    asked = rows.join(lists, ["id", "h"]).dropDuplicates(["id", "h"]).select("id", "h", "text", "centres")  # documents given twice

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs = b.column(0).to_numpy(), b.column(1).to_numpy()
            for s in ta.slices(b.column(2)):
                g, ptr = tokens(s)
                p = places(s, ptr, b.column(3))
                begin, end = np.maximum(p.low, p.at - REACH), np.minimum(p.high, p.at + REACH + 1)
                offsets = np.append(0, np.cumsum(end - begin))
                data = (g >> _U(11)).astype(np.uint16)[np.arange(offsets[-1]) + np.repeat(begin - offsets[:-1], end - begin)]
                strip = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((2 * offsets).astype(np.int32)), pa.py_buffer(data)])
                key, own, n = p.rest
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own), pa.array(n), pa.array(ids[p.row]), pa.array(hs[p.row]), pa.array((p.at - p.low).astype(np.int32)),
                                                  pa.array((p.at - begin).astype(np.int32)), strip], names=["key", "own", "n", "id", "h", "c", "at", "strip"])

    return asked.mapInArrow(released(run), "key long, own int, n int, id long, h int, c int, at int, strip binary")


def in_classes(strip: DataFrame) -> DataFrame:
    """One row for each class of equal strips of a key: key, cls and its first id, h and c.
    Strips are told apart by their hashes, so none is moved."""
    return strip.groupBy("key", "cls").agg(F.min(F.struct("id", "h", "c")).alias("f")).select("key", "cls", "f.*")


def of_classes(strip: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates of every window with the first of its class."""
    first = classes.select("key", "cls", F.col("id").alias("oid"), F.col("h").alias("oh"), F.col("c").alias("oc"))
    return (strip.select("key", "cls", "id", "h", "c", "at", "n").join(first, ["key", "cls"]).where((F.col("id") != F.col("oid")) | (F.col("h") != F.col("oh")))
            .select("id", "h", "oid", "oh", (F.col("c") - F.col("oc")).alias("dlo"), (F.col("c") - F.col("oc")).alias("dhi"),
                    (F.col("c") - F.col("at")).alias("first"), (F.col("c") - F.col("at") + F.col("n") - 1).cast("int").alias("last")))


def several(classes: DataFrame) -> DataFrame:
    """Classes of the keys that have them in several documents: key, own (a block of the key) and n blocks, first
    id, h and c.  Of keys with the same classes (other hash functions, the other side) one is kept."""
    doc, place = F.struct("id", "h"), ["id", "h", "c"]
    sizes = (classes.groupBy("key").agg(F.count("*").alias("m"), F.min(doc).alias("d0"), F.max(doc).alias("d1"),
                                        F.bit_xor(F.xxhash64(*place)).alias("s0"), F.bit_xor(F.xxhash64(*place[::-1], F.lit(1))).alias("s1"))
             .where("d0 <> d1").groupBy("m", "s0", "s1").agg(F.min("key").alias("key"))
             .select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("n")))
    return (classes.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id", "h", "c"), F.col("n")).cast("int"))
            .select("key", "own", "n", "id", "h", "c"))


def binary_tokens(strips_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All 16-bit tokens of a binary column and the offsets of its rows in them."""
    offsets = np.frombuffer(strips_.buffers()[1], dtype=np.int32)[strips_.offset:strips_.offset + len(strips_) + 1].astype(np.int64)
    data = np.frombuffer(strips_.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data.view(np.uint16), (offsets - offsets[0]) // 2


class Spans:
    """:func:`new_spans` for a row after the other; the spans of patterns that come again are remembered."""

    MOST = 1 << 16  # patterns

    def __init__(self, percent: int = PERCENT, least: int = MIN_TOKENS) -> None:
        self.percent, self.least = percent, least
        self.enough = -(-2 * percent * least // (100 + percent))  # shared tokens of a span
        self.known: dict[bytes, list[tuple[int, int, int]]] = {}

    def of(self, pattern: bytes) -> list[tuple[int, int, int]]:
        """Start, end and bits of the spans of a pattern, one bit for each token."""
        found = self.known.get(pattern)
        if found is None:
            if len(self.known) >= self.MOST:
                self.known.clear()
            found = self.known[pattern] = [(a, b, (1 << b) - (1 << a)) for a, b in joined_runs(runs_of(int.from_bytes(pattern, "little")), self.percent, self.least)]
        return found

    def new_spans(self, hit: np.ndarray, docs: np.ndarray) -> list[tuple[list[int], int, int]]:
        """(others, start, end) of spans that other strips share with one, of those that share most first; others
        whose spans earlier ones cover are left out, and those of a document that share the same tokens come together.

        ``hit``: tokens of the strip (255 at most) x others, 1 where the other has the token; ``docs``: of the others.
        """
        total = hit.sum(0, dtype=np.uint8)
        top = int(total.argmax())
        if total[top] < self.enough:
            return []
        same = np.flatnonzero((total == total[top]) & (docs == docs[top]))
        same = same[(hit[:, same] == hit[:, top:top + 1]).all(0)].tolist()
        out, covered = [], 0
        for a, b, bits in self.of(np.packbits(hit[:, top], bitorder="little").tobytes()):
            covered |= bits
            out.append((same, a, b))
        left_open = np.ones(len(hit), dtype=bool)
        for _, a, b in out:
            left_open[a:b] = False
        left = np.flatnonzero((total >= self.enough) & hit[left_open].any(0))  # the others have nothing new
        left = left[np.argsort(-total[left].astype(np.int16), kind="stable")]
        packed = np.packbits(hit[:, left], axis=0, bitorder="little")
        raw, width = packed.T.tobytes(), len(packed)
        alike: dict[bytes, list[int]] = {}
        for j, k in enumerate(left.tolist()):
            alike.setdefault(raw[j * width:(j + 1) * width], []).append(k)
        for pattern, rows in alike.items():
            if int.from_bytes(pattern, "little") & ~covered:
                for a, b, bits in self.of(pattern):
                    if bits & ~covered:
                        covered |= bits
                        out.append((rows, a, b))
        return out


def changed(*cols: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before it; the first does."""
    out = np.ones(len(cols[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return out


def bit_counts(words: np.ndarray) -> list[np.ndarray]:
    """For each bit of words (n x ...), how many of the n words have it: one array for each binary digit, the
    lowest first.  Words are added three at a time, to their sum without carry and their carry."""
    digits, todo = [], [words]
    while todo:
        now, carries = todo.pop(0), []
        while len(now) > 1:
            k = max(1, len(now) // 3)
            a, b, rest = now[:k], now[k:2 * k], now[2 * k:]
            odd = a ^ b
            if len(rest) >= k:
                carries.append(a & b | odd & rest[:k])
                odd ^= rest[:k]
                rest = rest[k:]
            else:
                carries.append(a & b)
            now = np.concatenate([odd, rest])
        digits.append(now[0])
        if todo or carries:
            todo = [np.concatenate([*todo, *carries])]
    return digits


def in_block(g: pa.Table, spans: Spans) -> list[np.ndarray]:
    """Candidates (as of ``across``) among the classes of a block or of two, in the order of their documents;
    ``g`` may hold several such groups, told apart by key, x and y.

    Only tokens of several documents can be shared.  Of classes with the same set of those tokens
    the first stands for all: it comes first for each later document and shares the same with it.
    The classes that have a token are bits of words, so all rows meet all earlier ones word by word.
    Where a strip shares the same with many windows of the other document (a repeated word), the
    diagonals of those near the first count as well if the classes are more than ``MANY``.
    """
    id_, h, c, at, own, x_, y_ = (g.column(k).to_numpy() for k in ("id", "h", "c", "at", "own", "x", "y"))
    n = len(id_)
    new = changed(g.column("key").to_numpy(), x_, y_)
    fresh = new | changed(id_, h)
    group, doc = np.cumsum(new) - 1, np.cumsum(fresh) - 1
    group_at = np.flatnonzero(new)
    many = np.diff(np.append(group_at, n))[group] > MANY
    toks, offsets = binary_tokens(g.column("strip").combine_chunks())
    row = np.repeat(np.arange(n), np.diff(offsets))
    width = int(np.diff(offsets).max())
    # Group, token (16 bits), row (20) and place in the strip (8) as one number.
    every = np.sort((group[row] << 44 | toks.astype(np.int64) << 28 | row << 8 | np.arange(len(toks)) - offsets[row]).view(_U)).view(np.int64)
    token, row, place = every >> 28, every >> 8 & 0xFFFFF, every & 0xFF
    fresh_token = changed(token)
    starts = np.flatnonzero(fresh_token)
    shared = doc[row[starts]] != doc[row[np.append(starts[1:], len(row)) - 1]]
    none = int(shared.sum())
    if not none:
        return []
    code = np.where(shared, np.cumsum(shared) - 1, none)[np.cumsum(fresh_token) - 1]
    table = np.full((n, width), none, dtype=np.int32)
    table[row, place] = code
    once = (fresh_token | changed(row)) & (code < none)
    row, code = row[once], code[once]
    sums = np.zeros(n, dtype=_U)
    np.add.at(sums, row, ta.mix64(code.astype(_U) + _U(1)))
    with_any = np.flatnonzero(np.bincount(row, minlength=n))
    _, head, of_set = np.unique(sums[with_any] ^ ta.mix64(own[with_any].astype(_U) + _U(1)), return_index=True, return_inverse=True)
    mine = with_any[head][of_set]  # the head of each row's set
    heads = np.sort(with_any[head])
    low, high = c.astype(np.int64), c.astype(np.int64)  # of heads: centres of alike windows near it
    near = many[mine] & (doc[mine] == doc[with_any]) & (abs(c[mine] - c[with_any]) <= 2 * REACH)
    np.minimum.at(low, mine[near], c[with_any[near]])
    np.maximum.at(high, mine[near], c[with_any[near]])
    is_head = np.zeros(n, dtype=bool)
    is_head[heads] = True
    before = np.append(0, np.cumsum(is_head))  # heads before a row
    base = before[group_at][group]             # those of earlier groups
    rank = before[:-1] - base                  # of a head in its group
    upto = before[np.flatnonzero(fresh)[doc]] - base  # heads of earlier documents
    wide = int(rank[heads].max()) // 64 + 1
    bit = _U(1) << (rank % 64).astype(_U)
    of_head = is_head[row]
    row, cell = row[of_head], code[of_head] * wide + rank[row[of_head]] // 64
    starts = np.flatnonzero(changed(cell)) if len(cell) else cell
    having = np.zeros((none + 1) * wide, dtype=_U)  # one bit for each head that has a token
    having[cell[starts]] = np.bitwise_or.reduceat(bit[row], starts)
    having = having.reshape(none + 1, wide)
    apart = x_ != y_
    side = np.where(apart, own == y_, 0).astype(np.int64)
    sides = np.zeros((len(group_at), 2, wide), dtype=_U)
    np.bitwise_or.at(sides, (group[heads], side[heads], rank[heads] // 64), bit[heads])

    rows = np.flatnonzero(((table < none).sum(1) >= spans.enough) & (upto > 0))
    if not len(rows):
        return []
    # Rows with the same tokens in the same places find the same.
    like = ta.mix64(table[rows].astype(_U) << _U(8) | np.arange(width, dtype=_U)).sum(1, dtype=_U) ^ ta.mix64((2 * upto + side)[rows].astype(_U))
    _, once, alike = np.unique(like, return_index=True, return_inverse=True)
    once = rows[once]
    out: list[tuple[np.ndarray, ...]] = []  # number in once, order, head, start, end, lowest and highest centre
    step = max(1, WORDS // (width * wide))
    for lo in range(0, len(once), step):
        k = once[lo:lo + step]
        left = (upto[k, None] - 64 * np.arange(wide)).clip(0, 64)
        early = np.where(left == 64, ~_U(0), (_U(1) << (left % 64).astype(_U)) - _U(1))
        early[apart[k]] &= sides[group[k], 1 - side[k]][apart[k]]
        j, word, place, a, b, same, rest = row_spans(having[table[k].T] & early, spans)
        first = heads[base[k[j]] + 64 * word + place]
        cl, ch = low[first], high[first]
        for i in np.flatnonzero(many[k[j]] & (np.bitwise_count(same).sum(1) > 1)).tolist():
            near = heads[base[k[j[i]]] + np.flatnonzero(np.unpackbits(same[i].view(np.uint8), bitorder="little"))]
            near = near[(doc[near] == doc[first[i]]) & (abs(c[near] - c[first[i]]) <= 2 * REACH)]
            cl[i], ch[i] = low[near].min(), high[near].max()
        out.append((lo + j, np.arange(len(j)), first, a, b, cl, ch))
        more: list[tuple[int, ...]] = []
        for j, hit in rest:
            r = int(k[j])
            others = heads[base[r]:base[r] + upto[r]]
            for order, (some, a, b) in enumerate(spans.new_spans(hit[:, :upto[r]], doc[others])):
                near = others[some]
                o = near[0]
                near = near[(doc[near] == doc[o]) & (abs(c[near] - c[o]) <= 2 * REACH)] if many[r] else near[:1]
                more.append((lo + j, order, int(o), a, b, int(low[near].min()), int(high[near].max())))
        if more:
            out.append(tuple(np.array(more, dtype=np.int64).T))
    which, order, *found = (np.concatenate(x) for x in zip(*out))
    by = np.lexsort((order, which))
    count = np.bincount(which, minlength=len(once))
    ends, each = np.cumsum(count), count[alike]
    k = np.repeat(rows, each)
    by = by[np.arange(len(k)) + np.repeat((ends - count)[alike] - (np.cumsum(each) - each), each)]
    o, a, b, lo, hi = (x[by] for x in found)
    if not len(k):
        return []
    start = c[k] - at[k]
    return [id_[k], h[k], id_[o], h[o], *(v.astype(np.int32) for v in (c[k] - hi - BAND, c[k] - lo + BAND, start + a, start + b - 1))]


def row_spans(hits: np.ndarray, spans: Spans) -> tuple:
    """As ``Spans.new_spans`` for many rows at a time, a turn for each next head: row, word and bit of the head,
    start, end and the heads that share just the same, for each span; and (row, hit as of ``Spans.new_spans``)
    of the rows that are not done when few are left or after ``TURNS``.

    ``hits``: places of a strip x rows x words, of each place's token the bits of the heads that have it.
    """
    width, n, wide = hits.shape
    ones, zero = ~_U(0), _U(0)
    digits = np.stack(bit_counts(hits))
    more, equal = np.zeros((n, wide), _U), np.full((n, wide), ones)  # heads that share more than or just ``enough``
    for d in range(max(len(digits), spans.enough.bit_length()) - 1, -1, -1):
        digit = digits[d] if d < len(digits) else np.zeros((n, wide), _U)
        if not spans.enough >> d & 1:
            more |= equal & digit
        equal &= digit if spans.enough >> d & 1 else ~digit
    left, at, covered = more | equal, np.arange(n), np.zeros((width, n), dtype=bool)
    found: list[tuple[np.ndarray, ...]] = []
    for turn in range(TURNS):
        if turn:
            left &= np.bitwise_or.reduce(np.where(covered[:, :, None], zero, hits), axis=0)  # the others have nothing new
        open_ = np.flatnonzero(left.any(1))
        if len(open_) < len(at):
            hits, digits, covered, left, at = hits[:, open_], digits[:, open_], covered[:, open_], left[open_], at[open_]
        if len(at) < FEW and turn or not len(at):
            break
        every, top, best = np.arange(len(at)), np.zeros(len(at), np.int64), left.copy()
        for d in range(len(digits) - 1, -1, -1):
            those = best & digits[d]
            some = those.any(1)
            best[some] = those[some]
            top += some.astype(np.int64) << d
        word = (best != 0).argmax(1)
        low = best[every, word]
        bit = np.bitwise_count((low & (~low + _U(1))) - _U(1)).astype(np.int64)
        hit = (hits[:, every, word] >> bit.astype(_U) & _U(1)).astype(bool)
        same = best & ~np.bitwise_or.reduce(hits ^ np.where(hit, ones, zero)[:, :, None], axis=0)
        left &= ~same
        a, b = hit.argmax(0), width - hit[::-1].argmax(0)
        # Spans are parted only where both sides together have too few matches; if all have enough, it is one span.
        whole = (100 + spans.percent) * top >= 2 * spans.percent * (b - a)
        inside = (np.arange(width)[:, None] >= a) & (np.arange(width)[:, None] < b) & (whole & (b - a >= spans.least))
        one = np.flatnonzero((inside & ~covered).any(0))
        covered |= inside
        parts = [(k, int(a[k]), int(b[k])) for k in one.tolist()]
        packed = np.packbits(hit.T, axis=1, bitorder="little")
        for k in np.flatnonzero(~whole).tolist():
            for p, q, _ in spans.of(packed[k].tobytes()):
                if not covered[p:q, k].all():
                    covered[p:q, k] = True
                    parts.append((k, p, q))
        if parts:
            k, a, b = np.array(parts, dtype=np.int64).T
            found.append((at[k], word[k], bit[k], a, b, same[k]))
    rest = [(int(at[k]), np.unpackbits(np.ascontiguousarray(hits[:, k]).view(np.uint8), axis=1, bitorder="little")) for k in np.flatnonzero(left.any(1)).tolist()]
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(5)), left[:0], rest)
    found = [np.concatenate(x) for x in zip(*found)]
    done = np.ones(n, dtype=bool)
    done[[k for k, _ in rest]] = False
    by = np.argsort(found[0], kind="stable")
    by = by[done[found[0][by]]]
    return (*(x[by] for x in found), rest)


def across(held: DataFrame) -> DataFrame:
    """Candidates of the first windows of different classes (as of ``class_strips``), compared in blocks."""
    rows = (held.withColumn("meets", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .select("key", F.least("own", "meets").alias("x"), F.greatest("own", "meets").alias("y"), "own", "id", "h", "c", "at", "strip"))
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y", "id", "h", "c")
    names = ["id", "h", "oid", "oh", "dlo", "dhi", "first", "last"]
    spans = Spans()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")])
            edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist()]
            rest = t.slice(edges[-1])
            yield from met(t, np.diff(edges))
        if rest is not None:
            yield from met(rest, np.array([rest.num_rows]))

    def met(t: pa.Table, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the first groups of ``t``.  Groups of a like size meet in a like number of words."""
        like = np.where(sizes > 1, np.frexp((sizes - 1) // 64)[1], -1)
        of_row = np.full(t.num_rows, -1)
        of_row[:sizes.sum()] = np.repeat(like, sizes)
        for w in np.unique(like[like >= 0]).tolist():
            if found := in_block(t.filter(pa.array(of_row == w)).combine_chunks(), spans):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=names)

    return rows.mapInArrow(released(run), "id long, h int, oid long, oh int, dlo int, dhi int, first int, last int")


def more_candidates(rows: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """Candidates as of ``candidates`` among all documents of a min-hash (``wanted``: as of
    ``crowded``), with repeats.  Its tables stay in ``folder``."""
    strip = written(around(rows, wanted), f"{folder}/around")
    classes = written(in_classes(strip), f"{folder}/classes")
    more = written(across(class_strips(rows, written(several(classes), f"{folder}/several"))), f"{folder}/across")
    return (of_classes(strip, classes).union(more)
            .select("id", "h", "oid", "oh", F.floor((F.col("dlo") + F.col("dhi")) / (2 * BAND)).alias("band"), "dlo", "dhi", "first", "last"))


def strips(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h, tile, strip): 16-bit token hashes of the tiles asked for."""
    lists = wanted.groupBy("id", "h").agg(F.sort_array(F.collect_list("tile")).alias("tiles"))  # at most a text's tiles
    asked = rows.join(lists, ["id", "h"]).select("id", "h", "text", "tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, hs, tiles = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3)
            for s in ta.slices(b.column(2)):
                g, ptr = tokens(s)
                small = (g >> _U(11)).astype(np.uint16)
                out: tuple[list, ...] = ([], [], [], [])
                for t in range(len(ptr) - 1):
                    k = s.first + t
                    own = small[ptr[t]:ptr[t + 1]]
                    for tile in tiles[k].as_py():
                        piece = own[tile * TILE:(tile + 1) * TILE]
                        if len(piece):
                            for col, v in zip(out, (ids[k], hs[k], tile, piece.tobytes())):
                                col.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())],
                                                     names=["id", "h", "tile", "strip"])

    return asked.mapInArrow(released(run), "id long, h int, tile int, strip binary").dropDuplicates(["id", "h", "tile"])


def shared_tokens(mine: pa.Array, others: pa.Array) -> np.ndarray:
    """For each tile one bit for each of its tokens that the other tile has too."""
    def tiles(strips_: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        toks, offsets = binary_tokens(strips_)
        at = np.minimum(offsets[:-1, None] + np.arange(TILE), offsets[1:, None] - 1)  # the last token again
        return toks[at], np.diff(offsets)

    x, size = tiles(mine)
    y, _ = tiles(others)
    hit = np.zeros(x.shape, dtype=bool)
    for j in range(TILE):
        hit |= x == y[:, j:j + 1]
    hit &= np.arange(TILE) < size[:, None]
    return np.packbits(hit, axis=1, bitorder="little").view(_U).ravel()


def spans_of(matched: np.ndarray, percent: int = PERCENT, least: int = MIN_TOKENS) -> list[tuple[int, int]]:
    """Spans [a, b) that begin and end with a match, of ``least`` or more positions, in
    which matched / (2 * length - matched) reaches ``percent`` per cent; left to right."""
    at = np.flatnonzero(matched)
    if len(at) < least * percent // 100:
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return joined_runs(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist()), percent, least)


def spans_of_tiles(masks: np.ndarray) -> list[tuple[int, int]]:
    """``spans_of`` the bits of consecutive tiles; of few tiles they are one number."""
    if len(masks) > 64:
        return spans_of(np.unpackbits(masks.view(np.uint8), bitorder="little").astype(bool))
    bits = int.from_bytes(masks.tobytes(), "little")
    return joined_runs(runs_of(bits), PERCENT, MIN_TOKENS) if bits.bit_count() >= MIN_TOKENS * PERCENT // 100 else []


def runs_of(bits: int) -> Iterator[tuple[int, int]]:
    """Start and end of each run of set bits, from the lowest."""
    at = 0
    while bits:
        gap = (bits & -bits).bit_length() - 1
        bits >>= gap
        run = (~bits & bits + 1).bit_length() - 1
        bits >>= run
        yield at + gap, at + gap + run
        at += gap + run


def joined_runs(runs: Iterable[tuple[int, int]], percent: int, least: int) -> list[tuple[int, int]]:
    """``spans_of`` the runs of matches."""
    out: list[tuple[int, int, int]] = []  # start, end, matched
    for a, b in runs:
        span = (a, b, b - a)
        while out:
            x, y, m = out[-1]
            n, k = span[1] - x, m + span[2]
            if 100 * k < percent * (2 * n - k):
                break
            out.pop()
            span = (x, span[1], k)
        out.append(span)
    return [(a, b) for a, b, _ in out if b - a >= least]


def repeats(docs: DataFrame, hashes: int = HASHES, enough: int = ENOUGH) -> DataFrame:
    """(id, h, start_word, end_word, oid, source_start): spans of words [start, end) that
    repeat a passage of an earlier document."""
    spark = docs.sparkSession
    ship(spark)
    rows = keyed(docs)
    folder = new_folder(spark, "repeats")
    met = written(met_windows(rows, hashes).drop("key"), f"{folder}/met")
    near = written(candidates(met, enough), f"{folder}/near")
    wanted = written(crowded(met), f"{folder}/crowded")
    delete(spark, f"{folder}/met")  # the largest table
    found = written(near.union(more_candidates(rows, wanted, folder))
                    .groupBy("id", "h", "oid", "oh", "band")
                    .agg(F.min("dlo").alias("dlo"), F.max("dhi").alias("dhi"), F.min("first").alias("first"), F.max("last").alias("last")), f"{folder}/found")
    for name in ("near", "crowded", "around", "classes", "several", "across"):
        delete(spark, f"{folder}/{name}")
    mine = found.withColumn("tile", F.explode(F.expr(f"sequence(CAST(first div {TILE} AS INT), CAST(last div {TILE} AS INT))")))
    lo, hi = (F.greatest(F.lit(0), F.floor((F.col("tile") * TILE + edge) / TILE)).cast("int") for edge in (-F.col("dhi"), TILE - 1 - F.col("dlo")))
    theirs = mine.where(hi >= 0).withColumn("otile", F.explode(F.sequence(lo, hi)))
    wanted = mine.select("id", "h", "tile").union(theirs.select("oid", "oh", "otile")).distinct()
    strip = written(strips(rows, wanted), f"{folder}/strips")
    other = strip.select(F.col("id").alias("oid"), F.col("h").alias("oh"), F.col("tile").alias("otile"), F.col("strip").alias("other"))
    both = theirs.join(other, ["oid", "oh", "otile"]).join(strip, ["id", "h", "tile"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = np.concatenate([shared_tokens(b.column(1).slice(lo, 1024), b.column(2).slice(lo, 1024)) for lo in range(0, b.num_rows, 1024)] or [np.zeros(0, _U)])
            yield pa.RecordBatch.from_arrays([*b.columns[3:], b.column(0), pa.array(masks.view(np.int64))], names=["id", "h", "oid", "oh", "band", "dlo", "tile", "mask"])

    hits = (both.select("tile", "strip", "other", "id", "h", "oid", "oh", "band", "dlo")
            .mapInArrow(released(compare), "id long, h int, oid long, oh int, band long, dlo int, tile int, mask long").where("mask <> 0"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    masks = (hits.groupBy("id", "h", "oid", "oh", "band", "dlo", "tile").agg(F.bit_or("mask").alias("mask"))
             .repartition(n, "id", "h").sortWithinPartitions("id", "h", "oid", "oh", "band", "tile"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            same = np.ones(t.num_rows - 1, dtype=bool)
            for c in ("id", "h"):
                x = t.column(c).to_numpy()
                same &= x[1:] == x[:-1]
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            rest = t.slice(cut)
            if cut:
                yield from of_documents(t.slice(0, cut))
        if rest is not None:
            yield from of_documents(rest)

    def of_documents(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: t.column(c).to_numpy() for c in t.column_names}
        doc = np.ones(t.num_rows, dtype=bool)
        pair = np.ones(t.num_rows, dtype=bool)
        doc[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in ("id", "h")])
        pair[1:] = np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in ("id", "h", "oid", "oh", "band")])
        starts = np.append(np.flatnonzero(pair), t.num_rows)
        out: list[tuple] = []
        mine_: list[tuple] = []

        def close() -> None:
            """Spans inside a longer one of the same document say nothing new."""
            mine_.sort(key=lambda x: (x[2], -x[3], x[4], x[5]))
            reach = -1
            for x in mine_:
                if x[3] > reach:
                    out.append(x)
                    reach = x[3]
            mine_.clear()

        for a, z in zip(starts, starts[1:]):
            if doc[a]:
                close()
            tile = cols["tile"][a:z]
            tiles = np.zeros(int(tile[-1] - tile[0]) + 1, dtype=np.int64)
            tiles[tile - tile[0]] = cols["mask"][a:z]
            for p, q in spans_of_tiles(tiles):
                p, q = p + int(tile[0]) * TILE, q + int(tile[0]) * TILE
                mine_.append((int(cols["id"][a]), int(cols["h"][a]), p, q + WIDTH - 1, int(cols["oid"][a]), int(cols["oh"][a]), max(0, p - int(cols["dlo"][a]))))
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()))],
                                             names=["id", "h", "start_word", "end_word", "oid", "oh", "source_start"])

    return masks.mapInArrow(released(spans), "id long, h int, start_word int, end_word int, oid long, oh int, source_start int")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row for each repeated passage of a later document: doc_id, start_word, end_word,
    n_words, source_doc_id (the earlier document) and source_start, about where there."""
    def known(c: str):
        return F.when(F.col(c) == LAST_ID, F.lit(None)).otherwise(F.col(c))

    return repeats(docs, **options).select(
        known("id").alias("doc_id"), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
        known("oid").alias("source_doc_id"), "source_start")


def without_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the words of repeated passages; n_chars follows the text.

    What is left around a cut is joined as it stands; a text that is a repeat as a whole
    becomes empty.  Texts without repeats stay as they are.
    """
    cuts = (repeats(docs, **options).groupBy("id", "h")
            .agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("_cuts"))  # of one text
            .withColumnRenamed("id", "_id").withColumnRenamed("h", "_h"))
    flat = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(docs.columns)],
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.pmod(F.xxhash64("text"), F.lit(1 << 31)).cast("int").alias("_h"))
    joined = flat.join(cuts, ["_id", "_h"], "left")
    place = {c: k for k, c in enumerate(docs.columns)}
    names = [f"_{k}" for k in range(len(docs.columns))]
    text_at = place["text"]
    count_at = place.get("n_chars")
    schema = T.StructType([T.StructField(f"_{k}", docs.schema[k].dataType) for k in range(len(docs.columns))])
    count_kind = docs.schema[count_at].dataType if count_at is not None else None

    def cut(text: str, spans: list[dict]) -> str:
        raw = text.encode()
        buf = np.frombuffer(raw, dtype=np.uint8)
        w = ta.words(buf, np.array([0, len(buf)]))
        out, at = [], 0
        for s in spans:
            a, z = s["start_word"], s["end_word"]
            begin = int(w.starts[a])
            end = int(w.starts[z]) if z < len(w.starts) else len(raw)
            if begin > at:
                out.append(raw[at:begin])
            at = max(at, end)
        out.append(raw[at:])
        return b"".join(out).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):  # few texts as Python objects at a time
                yield trimmed(b.slice(lo, 256))

    def trimmed(b: pa.RecordBatch) -> pa.RecordBatch:
        spans = b.column(len(names))
        hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False))
        cols = list(b.columns[:len(names)])
        if len(hit):
            texts = cols[text_at].to_pylist()
            counts = cols[count_at].to_pylist() if count_at is not None else None
            for k in hit:
                texts[k] = cut(texts[k], spans[k].as_py())
                if counts is not None:
                    counts[k] = len(texts[k])
            cols[text_at] = pa.array(texts, cols[text_at].type)
            if counts is not None and isinstance(count_kind, (T.LongType, T.IntegerType)):
                cols[count_at] = pa.array(counts, cols[count_at].type)
        return pa.RecordBatch.from_arrays(cols, names=names)

    done = joined.select(*names, "_cuts").mapInArrow(released(run), schema)
    return done.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(docs.columns)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)
