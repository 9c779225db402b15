"""k-means over weighted distinct vectors against the same rounds in plain Python."""
import math
import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postlens.operators import tokens as TK
from postlens.operators import topics as TP

from conftest import make_posts


def _round4(x):
    return math.floor(x * 10000 + 0.5) / 10000


def _plain(points, centres, rounds):
    """The reference's loop: assign, stop when nothing changes, new means; all begin in cluster 0."""
    part = [0] * len(points)
    for _ in range(rounds):
        scores = [[_round4(sum(c * c for c in m) - 2 * sum(a * b for a, b in zip(x, m))) for m in centres] for x in points]
        now = [s.index(min(s)) for s in scores]
        if now == part:
            break
        part = now
        for j in range(len(centres)):
            own = [x for x, p in zip(points, part) if p == j]
            if own:
                centres[j] = [sum(v) / len(own) for v in zip(*own)]
    return part


def _points(seed):
    r = random.Random(seed)
    base = [[r.choice([0, 0, 0, 1, 2, 3.5]) for _ in range(6)] for _ in range(40)]
    return [list(r.choice(base)) for _ in range(200)] + [[0.0] * 6] * 9


@pytest.mark.parametrize("margin", [TP.MARGIN, 1e9])  # 1e9: no vector is ever skipped
@pytest.mark.parametrize("seed, k, rounds", [(1, 2, 12), (2, 4, 12), (3, 5, 1), (4, 3, 2)])
def test_rounds_match_plain_loop(spark, monkeypatch, margin, seed, k, rounds):
    monkeypatch.setattr(TP, "MARGIN", margin)
    points = _points(seed)
    vectors = spark.createDataFrame([(str(i), Vectors.sparse(6, [(j, v) for j, v in enumerate(p) if v])) for i, p in enumerate(points)], ["tweet_id", "features"])
    start = [p for p in points if any(p)][:k]
    got = {int(r.tweet_id): r.cluster_id for r in TP.lloyd_from_first(vectors, k, rounds).collect()}
    assert [got[i] for i in range(len(points))] == _plain(points, [list(c) for c in start], rounds)


def test_equal_vectors_are_one_row(spark):
    vectors = spark.createDataFrame([(str(i), Vectors.sparse(3, {i % 3: 1.0})) for i in range(30)] + [("z", Vectors.sparse(3, {}))], ["tweet_id", "features"])
    rows = TP._distinct_vectors(vectors).collect()
    assert sorted(r.weight for r in rows) == [1, 10, 10, 10]
    assert sorted(len(r.cells) for r in rows) == [1, 2, 2, 2]


def test_later_rounds_skip_sure_vectors_and_shuffle_none(spark):
    points = [[x + d / 50, 0.0] for x in (1.0, 100.0) for d in range(50)]
    vectors = spark.createDataFrame([(str(i), Vectors.dense(p)) for i, p in enumerate(points)], ["tweet_id", "features"])
    rows = TP._distinct_vectors(vectors).cache()
    state = TP.lloyd(rows, [[1.0, 0.0], [50.0, 0.0]], 3)
    sure = state.where(F.col("upper") + TP.MARGIN < F.col("lower")).count()
    assert sure == 100
    plan = TP._assigned(rows, state, [[1.0, 0.0], [50.0, 0.0]], [0.0, 1.0])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("InMemoryRelation")[0] and "ShuffledHashJoin" in plan.split("InMemoryRelation")[0]


def test_starting_posts(spark):
    posts = make_posts(spark, [(str(i), None, f"alpha{i % 5} beta{i % 3} gamma", None) for i in range(20)] + [("x", None, "", None)])
    arrays = TK.token_arrays(posts)
    for start in ("random", "first"):
        found = [sorted(map(tuple, TP.kmeans_clusters(posts, arrays, 3, 50, 12, start)[0].select("tweet_id", "cluster_id").collect())) for _ in range(2)]
        assert found[0] == found[1] and len(found[0]) == 21
        summary = TP.kmeans_cluster_summary(posts, arrays, 3, 50, 12, start).collect()
        sizes = TP.cluster_sizes(TP.kmeans_clusters(posts, arrays, 3, 50, 12, start)[0], 3).collect()
        assert [(r.cluster_id, r.size) for r in summary] == [(r.cluster_id, r.size) for r in sizes]
    assert TP.kmeans(posts.limit(1), arrays.limit(1)) is None
    same = make_posts(spark, [("1", None, "same words", None), ("2", None, "same words", None), ("3", None, "same words", None)])
    assert [r.size for r in TP.kmeans_cluster_summary(same, TK.token_arrays(same), 3, 10, 12, "first").collect()] == [3, 0, 0]
