"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Document statistics are standardised and mapped to ``cos(Wx + b)``, whose inner
products approximate a Gaussian kernel.  Every partition sums its own normal
equations; the sums are added up in Spark and the ridge weights solved once.  On a
fold kept out of the fit, pooled-adjacent-violators over binned scores turns scores
into shares of good texts.

Defined results: a null text counts as empty and is scored like any text; repeated
rows get equal scores; without usable labels every score is the prior 0.5; an empty
table gives no rows.  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import docstats
from .cluster import checkpointed, released, ship

COMPONENTS = 128     # random Fourier features
WIDTH = 3.0          # of the Gaussian kernel, in standard deviations
RIDGE = 1e-3         # per row
BINS = 512           # of the raw score, for the calibration
KEEP = 0.3
SUM_ROWS = 16        # partial sums that reach the driver at most

FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is held out."""
    return F.crc32(doc_id.cast("string")) % FOLDS


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    edges: np.ndarray     # raw scores ...
    levels: np.ndarray    # ... and the calibrated score there; linear between

    def lift(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        np.clip(z, -8, 8, out=z)
        out = np.empty((len(x), len(self.b) + 1))
        out[:, 0] = 1
        out[:, 1:] = np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b))
        return out

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(x), self.edges, self.levels)


def features(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of the whole text; no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = docstats.features(docstats.batch_counts(b.column(1)))
            flat = pa.array(x.ravel())
            at = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(at, flat)], names=["doc_id", "x"])

    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum of ``per_batch(x, y)`` (``size`` doubles) over all rows, as a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += per_batch(_matrix(b.column(0)), b.column(1).to_numpy(zero_copy_only=False).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            for v in b.column(0).to_pylist():
                total += np.frombuffer(v)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])

    parts = rows.select("x", "y").mapInArrow(released(partial), "s binary").repartition(SUM_ROWS).mapInArrow(released(add), "s binary")
    return np.sum([np.frombuffer(r.s) for r in parts.collect()], axis=0)


def isotonic(scores: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; scores ascend. Returns the blocks' mean scores and levels."""
    blocks: list[list[float]] = []  # good, n, sum of scores
    for s, g, k in zip(scores, good, n):
        blocks.append([g, k, s * k])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return (np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", seed: int = 4) -> Model:
    """Fit on folds 2 to 4, calibrate on fold 1; fold 0 is never seen.

    Of several labels of one id the smallest counts.
    """
    known = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
             .groupBy("doc_id").agg(F.min(label).cast("int").alias("y")))
    rows = checkpointed(features(docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)))
                        .join(known, "doc_id").select("x", "y", fold(F.col("doc_id")).alias("fold")))
    fit, held = rows.where("fold <> 1"), rows.where("fold = 1")
    d = len(docstats.FEATURES)
    rng = np.random.default_rng(seed)
    w = rng.standard_normal((d, COMPONENTS)) / WIDTH
    b = rng.uniform(0, 2 * np.pi, COMPONENTS)

    moments = _summed(fit, lambda x, y: np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * d)
    n = moments[0]
    blank = Model(np.zeros(d), np.ones(d), w, b, np.zeros(COMPONENTS + 1), np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    if n == 0:
        return blank
    mean = moments[2:2 + d] / n
    scale = np.sqrt(np.maximum(moments[2 + d:] / n - mean**2, 0))
    scale[scale < 1e-9] = 1
    model = Model(mean, scale, w, b, blank.beta, blank.edges, blank.levels)

    m = COMPONENTS + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.lift(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = _summed(fit, normal, m * m + m)
    gram, right = total[:m * m].reshape(m, m), total[m * m:]
    penalty = np.full(m, RIDGE * n)
    penalty[0] = 0
    model.beta = np.linalg.lstsq(gram + np.diag(penalty), right, rcond=None)[0]

    def binned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        k = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(k, minlength=BINS), np.bincount(k, weights=y, minlength=BINS)])

    hist = _summed(held, binned, 2 * BINS)
    count, good = hist[:BINS], hist[BINS:]
    if not count.sum():
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    centres = (np.arange(BINS) + 0.5) / BINS * 2 - 0.5
    seen = count > 0
    model.edges, model.levels = isotonic(centres[seen], good[seen], count[seen])
    return model


def classified(docs: DataFrame, model: Model, columns: list[str], keep: float = KEEP) -> DataFrame:
    """``columns`` of every row as ``_0``, ``_1``, ... with ``_score`` and ``_predicted``; no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string").alias("_text"),
                       *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(columns) if c != "text"])
    place = {name: i for i, name in enumerate(rows.columns)}
    source = [0 if c == "text" else place[f"_{i}"] for i, c in enumerate(columns)]
    names = [*(f"_{i}" for i in range(len(columns))), "_score", "_predicted"]
    schema = T.StructType([*(T.StructField(f"_{i}", rows.schema[k].dataType) for i, k in enumerate(source)),
                           T.StructField("_score", T.DoubleType()), T.StructField("_predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(docstats.features(docstats.batch_counts(b.column(0)))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in source), pa.array(s), pa.array((s >= keep).astype(np.int32))], names=names)

    return rows.mapInArrow(released(run), schema)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """doc_id, score and predicted of every row."""
    return classified(docs, model, ["doc_id"], keep).toDF("doc_id", "score", "predicted")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts good, trained on the labelled ones of ``docs``.

    All columns stay as they are, also those called score or predicted.
    """
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    good = classified(docs, model, docs.columns).where("_predicted = 1")
    return good.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
