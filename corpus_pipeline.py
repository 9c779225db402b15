"""Corpus pipeline: stages over ``documents``, each written as Parquet and reread."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postlens.llm import bpe_chunks, ngram_join, quality_classifier, source_mixing, substring_dedup
from postlens.llm.cluster import delete, exists, shared_dir, shuffles_dropped

#: All but the last return the columns of their input.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier.stage),  # rejected documents go
    ("ngram_join", ngram_join.stage),                  # one document of each near-duplicate group stays
    ("substring_dedup", substring_dedup.stage),        # passages of earlier documents go
    ("source_mixing", source_mixing.stage),            # documents as often as the mix takes them
    ("bpe_chunks", bpe_chunks.stage),                  # token ids and round trip of each
]

#: A learned classifier and a tokenizer are stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Apply every stage to the whole of ``documents``.

    A run with the ``folder`` of one that failed goes on after its last finished stage;
    without one the stages are written to a folder of their own.  The output of a stage
    is deleted when the next one's is there.
    """
    root = (folder or f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}").rstrip("/")
    paths = [f"{root}/{k}-{name}" for k, (name, _) in enumerate(STAGES)]
    done = max((k for k, path in enumerate(paths) if exists(spark, f"{path}/_SUCCESS")), default=-1)
    docs = spark.read.parquet(paths[done] if done >= 0 else f"{sf_dir}/documents.parquet")
    for k in range(done + 1, len(STAGES)):
        with shuffles_dropped(spark):
            STAGES[k][1](spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
        docs = spark.read.parquet(paths[k])
        if k:
            delete(spark, paths[k - 1])
    return docs
