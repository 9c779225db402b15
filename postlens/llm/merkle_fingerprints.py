"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

Leaves are pieces of a paragraph (a line) that end after a word whose hash is a
multiple of ``LEAF_WORDS``, or with the paragraph; sections are runs of paragraphs
that end after one whose hash is a multiple of ``SECTION_PARAGRAPHS``.  Cuts depend on
content alone, so an edit changes the branches above it and no others.  Leaves cover
every byte of the text, hence equal roots mean equal texts (up to 64-bit collisions)
and differing branches locate edits.

A fingerprint is text: 32 hex digits of the root, then for each section ``/``, 8 hex
digits of the section and 8 for each of its leaves.  Likeness of two fingerprints is
the Dice coefficient of their leaves as multisets, 1 for equal roots.

Defined results: a null text counts as empty and empty texts have the fingerprint of
the empty tree (root only, likeness 1 with each other, 0 with others); null ids count
as smaller than all others; rows that share an id follow each other in order of text;
an only document is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .cluster import released, ship

LEAF_WORDS = 16
SECTION_PARAGRAPHS = 4
LOWEST = -(1 << 63)

_U = np.uint64


class Trees:
    """The trees of all texts of a slice: hashes of each level and the ptr of the level above."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        n, size = len(offsets) - 1, len(buf)
        w = ta.words(buf, offsets)
        closing = np.flatnonzero(ta.span_hashes(buf, w.starts, w.ends) % _U(LEAF_WORDS) == 0)
        closing = closing[closing + 1 < len(w.starts)]
        lines = np.flatnonzero(buf == 0x0A) + 1
        filled = offsets[:-1][np.diff(offsets) > 0]
        paragraphs = np.union1d(filled, lines[lines < size])
        leaves = np.union1d(paragraphs, w.starts[closing + 1])
        self.leaves = ta.span_hashes(buf, leaves, np.append(leaves[1:], size)) if len(leaves) else np.zeros(0, _U)
        p_ptr = np.searchsorted(leaves, paragraphs)
        p_hash = ta.run_hashes(self.leaves, p_ptr, np.append(p_ptr[1:], len(leaves)))
        p_text = np.searchsorted(offsets, paragraphs, "right") - 1
        first = np.ones(len(paragraphs), dtype=bool)
        if len(paragraphs):
            first[1:] = (p_text[1:] != p_text[:-1]) | (p_hash[:-1] % _U(SECTION_PARAGRAPHS) == 0)
        s_ptr = np.flatnonzero(first)
        self.sections = ta.run_hashes(p_hash, s_ptr, np.append(s_ptr[1:], len(p_hash)))
        self.section_leaf = p_ptr[s_ptr]                                      # first leaf of each section
        self.text_section = np.searchsorted(p_text[s_ptr], np.arange(n + 1))  # first section of each text
        self.text_leaf = np.searchsorted(leaves, offsets)
        self.n = n

    def fingerprints(self) -> list[str]:
        hexed = self.leaves.astype(">u8").tobytes().hex()
        s_hex = self.sections.astype(">u8").tobytes().hex()
        s_end = np.append(self.section_leaf[1:], len(self.leaves)).tolist()
        s_at, raw = self.section_leaf.tolist(), self.sections.astype("<u8").tobytes()
        out = []
        for i in range(self.n):
            a, b = int(self.text_section[i]), int(self.text_section[i + 1])
            parts = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).hexdigest()]
            for s in range(a, b):
                parts.append("/" + s_hex[16 * s:16 * s + 8])
                parts += [hexed[16 * k:16 * k + 8] for k in range(s_at[s], s_end[s])]
            out.append("".join(parts))
        return out

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        """A key for each leaf (text, hash as printed, how many equal ones before it) and its text."""
        text = ta.owner(self.text_leaf)
        key = ta.mix64(self.leaves >> _U(32)) ^ ta.mix64(text.astype(_U) + _U(1))
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = np.arange(len(key))
        nth = np.empty(len(key), dtype=np.int64)
        nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
        return ta.mix64(key + nth.astype(_U)), text


def likeness(a: Trees, b: Trees) -> np.ndarray:
    """Of text i of ``a`` with text i of ``b``."""
    (ka, ta_), (kb, _) = a.keyed(), b.keyed()
    common = np.bincount(ta_[np.isin(ka, kb)], minlength=a.n)
    total = np.diff(a.text_leaf) + np.diff(b.text_leaf)
    return np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1))


def fingerprint_likeness(a: str, b: str) -> float:
    """Of two fingerprints as text."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = (Counter(leaf for s in f[32:].split("/")[1:] for leaf in (s[k:k + 8] for k in range(8, len(s), 8))) for f in (a, b))
    total = sum(x.values()) + sum(y.values())
    return 2 * sum((x & y).values()) / total if total else 1.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, leaf in it) of ``a`` whose branch does not occur in ``b``."""
    if a[:32] == b[:32]:
        return []
    other = b[32:].split("/")[1:]
    whole = {s for s in other}
    leaves = {s[k:k + 8] for s in other for k in range(8, len(s), 8)}
    return [(i, k // 8 - 1) for i, s in enumerate(a[32:].split("/")[1:]) if s not in whole
            for k in range(8, len(s), 8) if s[k:k + 8] not in leaves]


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return (np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every text; no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in ta.slices(b.column(1)):
                n = len(s.offsets) - 1
                chars = np.add.reduceat(np.append((s.buf & 0xC0) != 0x80, False), np.minimum(s.offsets[:-1], len(s.buf))).astype(np.int64)
                chars[np.diff(s.offsets) == 0] = 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, n), pa.array(chars), pa.array(Trees(s.buf, s.offsets).fingerprints(), pa.string())],
                                                 names=["doc_id", "n_chars", "fingerprint"])

    return rows.mapInArrow(released(run), schema)


def with_next(docs: DataFrame) -> DataFrame:
    """The texts in partitions by ranges of the id, ids descending, with the row after each.

    Ranges come from quantiles of the ids, so they are fixed numbers: a recomputed task
    finds the same rows.  The highest text of a range is also sent to the range above it
    (and the highest of all to the lowest range), marked ``borrowed`` and sorted last.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"))
    cuts = rows.agg(F.percentile_approx("key", [k / n for k in range(1, n)], 10 * n)).head()[0] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), "right").astype("int32"))

    tops = {r["p"]: r["top"] for r in rows.groupBy(range_of("key").alias("p")).agg(F.max("key").alias("top")).collect()}
    ranges = sorted(tops)
    borrower = {tops[below]: above for below, above in zip(ranges, ranges[1:] + ranges[:1])}  # top of a range -> range that needs it
    needed = np.array(sorted(borrower), dtype=np.int64)
    needs = np.array([borrower[k] for k in needed.tolist()], dtype=np.int64)

    @F.pandas_udf("array<int>")
    def places(key: pd.Series) -> pd.Series:
        values = key.to_numpy()
        own = np.searchsorted(bounds, values, "right") * 2
        at = np.minimum(np.searchsorted(needed, values), max(len(needed) - 1, 0))
        hit = needed[at] == values if len(needed) else np.zeros(len(values), bool)
        return pd.Series([[int(o), int(needs[k]) * 2 + 1] if h else [int(o)] for o, k, h in zip(own, at, hit)])

    placed = (rows.withColumn("at", F.explode(places("key")))
              .select("doc_id", "text", "key", F.expr("at div 2").cast("int").alias("range"), (F.col("at") % 2).alias("borrowed")))
    return (placed.repartition(n, "range")
            .sortWithinPartitions("range", "borrowed", F.desc("key"), "text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """For every text its fingerprint, that of the text edited with the next document's
    beginning, and the likeness of the first to the second and to the next document's."""
    ship(docs.sparkSession)
    rows = with_next(docs)
    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(name, kind) for name, kind in (
        ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType())))])

    def emit(ids: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        edited = [t[:len(t) - len(t) // 2] + x[:len(t) // 2] for t, x in zip(texts, nexts)]
        own, new, after = (Trees(*_packed(x)) for x in (texts, edited, nexts))
        return pa.RecordBatch.from_arrays([
            pa.array(ids, id_type), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(own.fingerprints(), pa.string()), pa.array(new.fingerprints(), pa.string()),
            pa.array(likeness(own, new)), pa.array(likeness(own, after))], names=schema.names)

    id_type = pa.from_numpy_dtype(np.int64) if isinstance(schema["doc_id"].dataType, T.LongType) else pa.int32() if isinstance(schema["doc_id"].dataType, T.IntegerType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that still waits for its next: id, text, range
        ids, texts, nexts, held = [], [], [], 0
        for b in batches:
            for lo in range(0, b.num_rows, 64):  # few texts as Python objects at a time
                part = b.slice(lo, 64)
                for i, t, p, borrowed in zip(*(part.column(k).to_pylist() for k in (0, 1, 3, 4))):
                    if last is not None and last[2] == p:
                        ids.append(last[0])
                        texts.append(last[1])
                        nexts.append(t)
                        held += len(last[1])
                    last = None if borrowed else (i, t, p)
                    if held >= ta.SLICE_BYTES // 2:
                        yield emit(ids, texts, nexts)
                        ids, texts, nexts, held = [], [], [], 0
        if ids:
            yield emit(ids, texts, nexts)

    return rows.mapInArrow(released(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
