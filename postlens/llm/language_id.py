"""Language identification by language-bitmask n-gram filters.

A gram is a letter with the character before it and the two after it, in lower case,
where everything outside the word is a space; so each letter of a text gives one gram.
A language's grams are those in at least ``SHARE`` of its learning documents, counted
over all of them.

The filter is a bit-sliced Bloom filter: ``SLOTS`` slots hold a bit for each language, a
gram sets its languages' bits in ``HASHES`` slots, and the bitwise AND of those slots gives
at once every language that has the gram.  For a text, the bits of its distinct grams are
summed by language.  Of N grams that a language lacks, N * fill ** HASHES show its bit by
chance, fill being the share of slots with that bit; with that share taken out, the sums
decide, ties going to the first language.  The score is the winner's part of all sums.

The filter takes SLOTS / 8 bytes (128 KB) a language, however many documents there are.

Defined results: null texts and texts without a letter are ``und`` with score 0; texts
with letters but no known gram get the language with most learning documents, with score
0; rows with a null id are neither learned from nor held out; rows without lang are not
learned from; where nothing was learned every text is ``und``; other columns are not read;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .cluster import released, ship

SHARE = 0.05
SLOTS = 1 << 20
HASHES = 3
_SHIFT = 21          # bits of a gram's hash between those of its slots
UNKNOWN = "und"

_U = np.uint64
_SPACE = _U(32)


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of each text as hashes, and their texts in ascending order."""
    lowered = [t.lower() for t in texts]
    raw = np.frombuffer(" ".join([*lowered, ""]).encode("utf-32-le", "replace"), dtype=np.uint32)
    if not len(raw):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    kinds, place = np.unique(raw, return_inverse=True)
    letter = np.array([chr(c).isalpha() for c in kinds.tolist()], dtype=bool)[place]
    at = np.flatnonzero(letter)
    x = raw[at].astype(_U)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])[at]
    n = len(at)
    joined = np.zeros(n + 1, dtype=bool)       # letter k is in the word of letter k - 1
    joined[1:n] = np.diff(at) == 1
    follows = np.append(x[1:], _SPACE)
    second = np.append(follows[1:], _SPACE)
    before = np.where(joined[:n], np.append(_SPACE, x[:-1])[:n], _SPACE)
    after = np.where(joined[1:], follows, _SPACE)
    after2 = np.where(joined[1:] & np.append(joined[2:], False)[:n], second, _SPACE)
    grams = ta.mix64(ta.mix64((before << _U(21)) | x) + ((after << _U(21)) | after2))
    _, first = np.unique(grams ^ ta.mix64(text.astype(_U) + _U(1)), return_index=True)
    first.sort()
    return grams[first], text[first]


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Whole texts of a batch, about ``ta.SLICE_BYTES`` at a time; null as empty."""
    texts, first, held = [], 0, 0
    for i, t in enumerate(column):
        texts.append(t.as_py() or "")
        held += len(texts[-1])
        if held >= ta.SLICE_BYTES:
            yield first, texts
            texts, first, held = [], i + 1, 0
    if texts:
        yield first, texts


class Filter(NamedTuple):
    languages: list[str]     # in order of their bits
    documents: list[int]     # learned from, by language
    masks: np.ndarray        # uint64 (SLOTS, words of 64 languages)

    def fills(self) -> np.ndarray:
        """Share of slots that hold the bit of each language."""
        return np.array([np.count_nonzero(self.masks[:, k >> 6] & _U(1 << (k & 63))) for k in range(len(self.languages))]) / len(self.masks)


def slots_of(grams: np.ndarray, k: int) -> np.ndarray:
    return ((grams >> _U(_SHIFT * k)) & _U(SLOTS - 1)).astype(np.int64)


def languages_of(masks: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Bits of all languages that hold each gram, false positives included."""
    out = masks[slots_of(grams, 0)]
    for k in range(1, HASHES):
        out &= masks[slots_of(grams, k)]
    return out


def learn(docs: DataFrame, learned: Column) -> Filter:
    """The filter over ``docs`` (text, lang) where ``learned`` holds and lang is not null."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.where(learned & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    per_language = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"].encode())  # a row for each language
    languages, documents = [r["lang"] for r in per_language], [r["count"] for r in per_language]
    code = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([code[x] for x in b.column(0).to_pylist()], dtype=np.int64)
            for first, texts in _parts(b.column(1)):
                grams, text = letter_grams(texts)
                own = codes[first + text]
                for c in np.unique(own).tolist():
                    found, count = np.unique(grams[own == c], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), c)), pa.array(ta.as_int64(found)), pa.array(count)], names=["code", "gram", "df"])

    counted = rows.mapInArrow(released(run), "code long, gram long, df long").groupBy("code", "gram").agg(F.sum("df").alias("df"))
    masks = np.zeros((SLOTS, max(1, (len(languages) + 63) // 64)), dtype=_U)
    if languages:
        least = F.array(*(F.lit(max(1.0, SHARE * n)) for n in documents))
        slots = F.array(*(F.shiftrightunsigned("gram", _SHIFT * k).bitwiseAND(F.lit(SLOTS - 1)) for k in range(HASHES)))
        merged = (counted.where(F.col("df") >= F.get(least, F.col("code").cast("int"))).select("code", F.explode(slots).alias("slot"))
                  .groupBy("slot", F.shiftright("code", 6).alias("word"))
                  .agg(F.bit_or(F.expr("shiftleft(1L, cast(code & 63 as int))")).alias("bits")).toArrow())  # SLOTS rows for 64 languages at most
        masks[merged["slot"].to_numpy(), merged["word"].to_numpy()] = merged["bits"].to_numpy().view(_U)
    return Filter(languages, documents, masks)


def predict(docs: DataFrame, found: Filter, key: list[str]) -> DataFrame:
    """``key`` columns, lang_pred and score of every row."""
    ship(docs.sparkSession)
    rows = docs.select(*key, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(rows.schema[c] for c in key), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    fills = found.fills()
    chance = np.minimum(fills ** HASHES, 1 - 1e-9)
    commonest = max(range(len(found.languages)), key=lambda i: found.documents[i], default=None)
    languages, masks = found.languages, found.masks

    def decided(texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, text = letter_grams(texts)
        n = np.bincount(text, minlength=len(texts))
        if not languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = languages_of(masks, grams)
        counts = np.stack([np.bincount(text[(bits[:, k >> 6] >> _U(k & 63)) & _U(1) == 1], minlength=len(texts)) for k in range(len(languages))], axis=1)
        sure = np.maximum((counts - n[:, None] * chance) / (1 - chance), 0)
        best, total = sure.argmax(axis=1), sure.sum(axis=1)
        best = np.where(total > 0, best, commonest)
        score = np.where(total > 0, sure.max(axis=1) / np.maximum(total, 1e-300), 0.0)
        return [languages[k] if has else UNKNOWN for k, has in zip(best.tolist(), n > 0)], score

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, texts in _parts(b.column(len(key))):
                names, score = decided(texts)
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, len(texts)) for i in range(len(key))),
                                                  pa.array(names, pa.string()), pa.array(score)], names=schema.names)

    return rows.mapInArrow(released(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = learn(docs, fold != 2)
    held_out = docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    return predict(held_out, found, ["doc_id", "held_out"])
