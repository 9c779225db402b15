"""The pipeline stage by stage on a small corpus."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from postlens.llm import bpe_chunks, ngram_join, quality_classifier, substring_dedup  # noqa: E402


def test_pipeline(spark):
    sf = "/root/testdata/sf0.01"
    docs = start = spark.read.parquet(f"{sf}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_join", "substring_dedup", "source_mixing", "bpe_chunks"]
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == start.columns, name
        rows[name] = out.collect()
        docs = spark.createDataFrame(rows[name], start.schema)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in rows["quality_classifier"]}
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in good) > 0.97 * len(good) and sum(i in kept for i in bad) < 0.2 * len(bad)
    comps = {r.doc_id: r.component_id for r in ngram_join.join(spark.createDataFrame(rows["quality_classifier"], start.schema), ngram_join.STAGE_WIDTH, ngram_join.STAGE_PERCENT).collect()}
    assert sorted(r.doc_id for r in rows["ngram_join"]) == sorted(set(comps.values()))
    assert len(rows["substring_dedup"]) == len(rows["ngram_join"])
    assert substring_dedup.report(spark.createDataFrame(rows["substring_dedup"], start.schema)).count() <= 3
    texts = {r.doc_id: r.text for r in rows["substring_dedup"]}
    assert rows["source_mixing"] and all(r.text == texts[r.doc_id] for r in rows["source_mixing"])
    last = bpe_chunks.stage(spark, docs, sf).count()
    assert last == len(rows["source_mixing"])
    assert quality_classifier.KEEP == 0.3


def test_a_failed_run_goes_on_after_its_last_stage(spark, tmp_path, monkeypatch):
    """Stages that only count their calls: the run fails in the third, the next goes on there."""
    calls, broken = [], [True]

    def stage(name):
        def run(spark, docs, sf_dir):
            calls.append(name)
            if name == "c" and broken:
                raise RuntimeError("lost")
            return docs.withColumn("text", F.concat("text", F.lit(name)))
        return run

    spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, stage(n)) for n in "abcd"])
    folder = str(tmp_path / "run")
    try:
        corpus_pipeline.run(spark, str(tmp_path), folder)
    except RuntimeError:
        broken.clear()
    got = corpus_pipeline.run(spark, str(tmp_path), folder)
    assert calls == ["a", "b", "c", "c", "d"] and sorted(r.text for r in got.collect()) == ["xabcd", "yabcd"]
    assert sorted(p.name for p in (tmp_path / "run").iterdir()) == ["3-d"]
    assert sorted(r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ["xabcd", "yabcd"]
