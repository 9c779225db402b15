"""Quality rules: a decision list learned by sequential covering.

``statistics`` counts over whole texts; ``learn`` grows conjunctions of threshold
tests on labelled statistics (gain against the rows still uncovered), prunes each
on rows that it was not grown on, and stops when a pruned rule is no better than
chance; ``verdict`` turns the ordered rules into one Spark ``CASE WHEN``.

Defined results: a null text counts as empty; empty texts fail the base rule (fewer
than 50 words); repeated rows give repeated results; without usable labels (or with
one class only) the list is empty and its default keeps; an empty table gives no
rows.  Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import docstats
from .cluster import released, ship

#: Labelled rows that a list is learned from at most, those of smallest hash of the id.
SAMPLE_ROWS = 20_000

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass
class Test:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.threshold) if self.at_least else c < F.lit(self.threshold)

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.at_least else x[self.feature] < self.threshold


@dataclass
class Rule:
    tests: list[Test]
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n = len(next(iter(x.values())))
        return np.logical_and.reduce([np.ones(n, dtype=bool), *(t.holds(x) for t in self.tests)])

    def __str__(self) -> str:
        return " AND ".join(f"{t.feature} {'>=' if t.at_least else '<'} {t.threshold:.6g}" for t in self.tests)


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, the default keeps."""

    rules: list[Rule] = field(default_factory=list)

    def verdict(self) -> Column:
        out = None
        for r in self.rules:
            cond = F.lit(True)
            for t in r.tests:
                cond = cond & t.column()
            out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
        return F.lit(True) if out is None else out.otherwise(F.lit(True))

    def fired(self) -> Column:
        """Number of the rule that decides, from 1; 0 for the default."""
        out = F.lit(0)
        for k, r in reversed(list(enumerate(self.rules, 1))):
            cond = F.lit(True)
            for t in r.tests:
                cond = cond & t.column()
            out = F.when(cond, F.lit(k)).otherwise(out)
        return out


def _gain(p0: float, n0: float, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Information gained about the target rows that stay covered."""
    base = np.log2(p0 / (p0 + n0))
    with np.errstate(divide="ignore", invalid="ignore"):
        g = p * (np.log2(p / (p + n)) - base)
    return np.where(p > 0, g, -1.0)


def _best_test(x: dict[str, np.ndarray], target: np.ndarray, cuts: dict[str, np.ndarray]) -> tuple[float, Test | None]:
    p0, n0 = float(target.sum()), float((~target).sum())
    best: tuple[float, Test | None] = (0.0, None)
    for name, values in x.items():
        edges = cuts[name]
        if not len(edges):
            continue
        side = np.searchsorted(edges, values, "right")  # values >= edges[k] have side > k
        p = np.bincount(side[target], minlength=len(edges) + 1)
        n = np.bincount(side[~target], minlength=len(edges) + 1)
        p_below, n_below = np.cumsum(p)[:-1], np.cumsum(n)[:-1]
        for at_least, pp, nn in ((True, p0 - p_below, n0 - n_below), (False, p_below, n_below)):
            g = _gain(p0, n0, pp.astype(float), nn.astype(float))
            k = int(np.argmax(g))
            if g[k] > best[0] + 1e-9:
                best = (float(g[k]), Test(name, at_least, float(edges[k])))
    return best


def learn_list(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 16, max_tests: int = 4,
               n_cuts: int = 64, min_cover: int = 5, min_precision: float = 0.6, seed: int = 7) -> DecisionList:
    """Sequential covering of the ``bad`` rows. ``x``: a column for each feature."""
    rng = np.random.default_rng(seed)
    grow = rng.random(len(bad)) < 2 / 3
    left = np.ones(len(bad), dtype=bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and (left & grow & bad).sum() >= min_cover and (left & grow & ~bad).sum():
        rows = left & grow
        cuts = {k: np.unique(np.quantile(v[rows & bad], np.linspace(0, 1, n_cuts))) for k, v in x.items()}
        tests: list[Test] = []
        covered = rows.copy()
        while len(tests) < max_tests and (covered & ~bad).any():
            sub = {k: v[covered] for k, v in x.items()}
            _, t = _best_test(sub, bad[covered], cuts)
            if t is None:
                break
            tests.append(t)
            covered &= t.holds(x)
        if not tests:
            break
        # Prune: drop trailing tests while the rows kept aside speak for the shorter rule.
        held = left & ~grow

        def worth(k: int) -> float:
            hit = Rule(tests[:k], 0).holds(x) & held
            p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        k = max(range(1, len(tests) + 1), key=lambda k: (worth(k), -k))
        rule = Rule(tests[:k], 0)
        hit = rule.holds(x) & left
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        rule.precision = p / max(p + n, 1)
        if p < min_cover or rule.precision < min_precision:
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(rules)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the counts and the ratios of every text; one pass, no shuffle."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join([f"doc_id {kind}", *(f"{c} bigint" for c in docstats.COUNTS), *(f"{c} double" for c in docstats.FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = docstats.batch_counts(b.column(1))
            f = docstats.features(c)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c[:, i]) for i in range(c.shape[1])), *(pa.array(f[:, i]) for i in range(f.shape[1]))],
                names=["doc_id", *docstats.COUNTS, *docstats.FEATURES])

    return rows.mapInArrow(released(run), schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def learn(stats: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label: str = "quality",
          usable: Callable[[Column], Column] | None = None) -> DecisionList:
    """Learn from at most ``sample_rows`` labelled rows that pass the base rule.

    Of several labels of one id the smallest counts; null ids and labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias("_label"))
    if usable is not None:
        known = known.where(usable(F.col("doc_id")))
    n = known.count()
    if n > sample_rows:
        # By a cut-off on the hash, so that tasks do not each send a full sample to the driver.
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int((1 << 40) * sample_rows / n))
    rows = stats.where(~base_failed()).join(known, "doc_id")
    sample = (rows.orderBy(F.xxhash64("doc_id"), "doc_id", *docstats.FEATURES).limit(sample_rows)
              .select(*docstats.FEATURES, "_label").toPandas())
    if not len(sample):
        return DecisionList()
    return learn_list({f: sample[f].to_numpy(float) for f in docstats.FEATURES}, sample["_label"].to_numpy() == 0)


def apply_rules(docs: DataFrame, rules: DecisionList) -> DataFrame:
    failed = base_failed()
    return statistics(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), F.when(failed, F.lit(False)).otherwise(rules.verdict()).alias("kept"),
        F.when(failed, F.lit(-1)).otherwise(rules.fired()).alias("rule"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5 == 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = learn(statistics(docs), labels, usable=lambda c: ~held_out(c))
    return apply_rules(docs, rules)
