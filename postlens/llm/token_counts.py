"""Token counts by a trie-shared unigram dynamic programme.

Pre-tokens are the words ``[^\\x20\\x09-\\x0D]+`` of a text, each with a leading word
mark.  A task inserts its distinct pre-tokens in a trie (visited in sorted order, so
the path to the last pre-token is all that is held) and computes the forward scores
of every shared prefix once: the best score of a segmentation of the prefix into
vocabulary pieces, and its number of pieces.  The terminal count of each pre-token is
kept and summed over the words of every text.

The vocabulary is that of a public sentencepiece model.  Its file holds the order of its
pieces, merge ranks, and no probabilities; a unigram score is a log-probability, so the
piece of rank r (1 for the first) gets that of Zipf's law, ln(1 / (r * H)), H being the sum of
all 1 / r.  Common pieces then win over many short ones, as they do where scores are learned.
A character without a piece of its own costs ``UNKNOWN`` below the lowest score and
counts as its UTF-8 bytes.  Of equally good segmentations the one of fewest tokens
counts.

Defined results: a null text and a text without words have no tokens; repeated rows
give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .cluster import released, ship

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
MEMO_WORDS = 600_000  # remembered pre-tokens of a task, about 90 MB


class Unigram:
    """Pieces with scores; terminal counts of the pre-tokens seen so far."""

    _have: dict[str, "Unigram"] = {}

    def __init__(self, pieces: dict[str, float]) -> None:
        self.pieces = pieces
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN
        ends: dict[str, set[int]] = {}
        for p in pieces:
            ends.setdefault(p[-1], set()).add(len(p))
        self.lengths = {c: tuple(sorted(v)) for c, v in ends.items()}  # of the pieces that end in a character
        self.memo: dict[bytes, int] = {}

    @classmethod
    def of_model(cls, model: bytes) -> "Unigram":
        key = hashlib.sha256(model).hexdigest()
        if key not in cls._have:
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=model)
            ranked = sorted((i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))),
                            key=lambda i: (-sp.get_score(i), i))
            total = math.fsum(1 / r for r in range(1, len(ranked) + 1))
            cls._have[key] = cls({sp.id_to_piece(i): -math.log(r * total) for r, i in enumerate(ranked, 1)})
        return cls._have[key]

    def counts(self, ranked: list[str]) -> list[int]:
        """Tokens of every pre-token; ``ranked`` ascends."""
        pieces, lengths, unknown = self.pieces, self.lengths, self.unknown
        best, tokens = [0.0], [0]  # forward scores along the trie path of the last pre-token
        last, out = "", []
        for word in ranked:
            shared, most = 0, min(len(word), len(last))
            while shared < most and word[shared] == last[shared]:
                shared += 1
            del best[shared + 1:], tokens[shared + 1:]
            for j in range(shared + 1, len(word) + 1):
                c = word[j - 1]
                top, n, single = float("-inf"), 0, False
                for k in lengths.get(c, ()):
                    if k > j:
                        break
                    score = pieces.get(word[j - k:j])
                    if score is not None:
                        single = single or k == 1
                        score += best[j - k]
                        if score > top or score == top and tokens[j - k] + 1 < n:
                            top, n = score, tokens[j - k] + 1
                if not single:
                    score = best[j - 1] + unknown
                    m = tokens[j - 1] + len(c.encode())
                    if score > top or score == top and m < n:
                        top, n = score, m
                best.append(top)
                tokens.append(n)
            last = word
            out.append(tokens[-1])
        return out

    def learn(self, words: list[bytes]) -> None:
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_WORDS and self.memo:
            self.memo = {}
            new = set(words)
        ranked = sorted(new)  # UTF-8 order is code point order
        self.memo.update(zip(ranked, self.counts([MARK + w.decode() for w in ranked])))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_words and n_tokens of every whole text; no shuffle."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # one vocabulary file, under 1 MB
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram = Unigram.of_model(model.value)
        try:
            for b in batches:
                for s in ta.slices(b.column(1)):
                    raw, at = s.buf.tobytes(), s.offsets.tolist()
                    words = [raw[a:z].split() for a, z in zip(at, at[1:])]  # bytes split at the six ASCII separators
                    unigram.learn([w for text in words for w in text])
                    get = unigram.memo.__getitem__
                    n = len(words)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).slice(s.first, n), pa.array([len(w) for w in words], pa.int64()),
                         pa.array([sum(map(get, w)) for w in words], pa.int64())], names=schema.names)
        finally:
            unigram.memo = {}  # the worker process lives on in other stages

    return rows.mapInArrow(released(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
