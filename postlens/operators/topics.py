"""TF-IDF vectors and k-means clustering of posts.

* vocabulary: the ``max_features`` words with the highest document frequency
  (ties by word); at most that many rows reach the driver;
* vectors: ``CountVectorizerModel`` over each post's token array, scaled by
  idf = ln((1 + N) / (1 + df)) + 1 (``ElementwiseProduct``; no normalisation;
  posts without any vocabulary word keep an all-zero vector), N = all posts;
* starting centres: the vectors of k posts, either a sample by a hash of the id and a seed
  (``start="random"``) or the k posts of smallest numeric id whose vector is not zero
  (``start="first"``, which SQL can state as well);
* clustering: Lloyd rounds (squared Euclidean distance), at most ``max_iter`` assignments,
  ending when no post changes its cluster.  Distances are compared after rounding to 4
  places (without the post's own norm), so that sums in another order give the same
  result; ties go to the lower cluster and an empty cluster keeps its centre;
* summary: size per cluster and the eight words with the largest summed weight.

How the rounds run
------------------
Posts with equal vectors are one row with a weight, dealt once by the vector's id.  That
table and the state of the rounds (cluster and two bounds for each vector) are kept in the
same partitioning, so no round has an exchange but for at most k * k * max_features sums.
A round reads each of them once.
The bounds are those of the triangle inequality: a vector's distance to its own centre
grows by what that centre moved at most, the distance to any other shrinks by the
farthest move at most.  While the first stays below the second the vector is
skipped; the others are compared with all centres in one aggregation over their non-zero
weights.  Only vectors that change cluster enter the new sums.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import checkpointed, materialize, shuffle_partitions

SEED = 42
# More than rounding a squared distance to 4 places can move a distance, both ways.
MARGIN = 0.03
_ID = ["_a", "_b"]


def _vocab(arrays: DataFrame, max_features: int) -> list[tuple[str, int]]:
    rows = (arrays.select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token")
            .agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), F.asc("token")).limit(max_features).collect())
    return [(r["token"], r["df"]) for r in rows]


def tfidf_vectors(posts: DataFrame, arrays: DataFrame, max_features: int = 200):
    """(vectors DataFrame[tweet_id, features] or None, vocabulary list, idf list, n_posts).
    ``arrays`` has one row per post; posts without tokens get a zero vector.  The vocabulary
    and the number of posts are read while the plan is built."""
    n_docs = posts.count()
    vocab = _vocab(arrays, max_features)
    words = [w for w, _ in vocab]
    idf = [math.log((1 + n_docs) / (1 + df)) + 1 for _, df in vocab]
    if not words:
        return None, words, idf, n_docs
    docs = arrays.select("tweet_id", "tokens")
    cv = CountVectorizerModel.from_vocabulary(words, inputCol="tokens", outputCol="tf")
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="tf", outputCol="features")
    return scale.transform(cv.transform(docs)).select("tweet_id", "features"), words, idf, n_docs


def _doubles(values: list[float]) -> Column:
    """A literal array, as one text for the analyser; the optimiser folds it."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _cells() -> list[Column]:
    """Features ``i`` and values ``v`` (all of a dense vector) of a vector."""
    v = F.unwrap_udt("features")
    return [F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)).alias("i"), v["values"].alias("v")]


def _with_id(vectors: DataFrame) -> DataFrame:
    """``vectors`` with a 128-bit id of their features and values."""
    return vectors.select("*", *_cells()).withColumn("_a", F.xxhash64("i", "v")).withColumn("_b", F.xxhash64("v", "i", F.lit(1))).drop("i", "v")


def _distinct_vectors(vectors: DataFrame) -> DataFrame:
    """One row for each distinct vector: id, ``weight`` (posts), ``norm`` (squared) and
    ``cells`` (feature, value), with a cell (-1, 1) that counts the vector itself."""
    known = vectors if set(_ID) <= set(vectors.columns) else _with_id(vectors)
    each = (known.select(*_ID, *_cells()).groupBy(*_ID)
            .agg(F.count(F.lit(1)).alias("weight"), F.first("i").alias("i"), F.first("v").alias("v")))
    one = F.array(F.struct(F.lit(-1).alias("i"), F.lit(1.0).alias("v")))
    cells = F.concat(one, F.arrays_zip("i", "v"))
    norm = F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x)
    return each.select(*_ID, "weight", norm.alias("norm"), cells.alias("cells")).repartition(shuffle_partitions(vectors.sparkSession), *_ID)


def _assigned(rows: DataFrame, state: DataFrame | None, centres: list[list[float]], moved: list[float] | None) -> DataFrame:
    """The state after an assignment: id, cluster before and now, and the bounds ``upper``
    (distance to the own centre) and ``lower`` (to any other).

    ``state`` is that after the one before, and ``moved`` how far each centre has moved
    since; vectors whose bounds, shifted by that, stay apart keep their cluster.
    """
    k, m = len(centres), len(centres[0])
    if state is None:
        known = rows.select(*_ID, "norm", "cells", F.lit(-1).alias("before"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    else:
        others = [max(moved[:j] + moved[j + 1:]) for j in range(k)]
        shifted = state.select(*_ID, F.col("cluster_id").alias("before"), (F.col("upper") + F.get(_doubles(moved), F.col("cluster_id"))).alias("upper"),
                               (F.col("lower") - F.get(_doubles(others), F.col("cluster_id"))).alias("lower"))
        known = rows.join(shifted.hint("shuffle_hash"), _ID)
    unsure = F.col("upper") + F.lit(MARGIN) >= F.col("lower")
    kept = [*_ID, "norm", "before", "upper", "lower"]
    # Squared distance less the norm is |c|^2 - 2 c.x; cell -1 brings |c|^2.  All numbers are in one
    # array that cells look up, so the generated code is the same in every round.
    flat = _doubles([v for c in centres for v in (sum(x * x for x in c), *(-2.0 * x for x in c))])
    dots = [F.sum(F.col("cell.v") * F.get(flat, F.col("cell.i") + F.lit(j * (m + 1) + 1))).alias(f"_d{j}") for j in range(k)]
    found = known.select(*kept, F.explode_outer(F.when(unsure, F.col("cells"))).alias("cell")).groupBy(*kept).agg(*dots)
    best = found.select(*kept, *(C.round_half_up(F.col(f"_d{j}"), 4).alias(f"_s{j}") for j in range(k)))
    best = best.withColumn("_best", F.least(*(F.struct(F.col(f"_s{j}").alias("s"), F.lit(j).alias("j")) for j in range(k))))
    next_best = F.least(*[F.when(F.col("_best.j") != j, F.col(f"_s{j}")) for j in range(k)])

    def distance(score: Column) -> Column:
        return F.sqrt(F.greatest(F.col("norm") + score, F.lit(0.0)))

    def renewed(new: Column, old: str) -> Column:
        return F.when(unsure, new).otherwise(F.col(old))

    return best.select(*_ID, "before", renewed(F.col("_best.j"), "before").alias("cluster_id"),
                       renewed(distance(F.col("_best.s")), "upper").alias("upper"), renewed(distance(next_best), "lower").alias("lower"))


def _sums(rows: DataFrame, state: DataFrame, by: list[str]) -> list:
    """Weighted sums of the cells of ``state``'s vectors; feature -1 counts posts."""
    cells = (rows.join(state.select(*_ID, *by).hint("shuffle_hash"), _ID)
             .select(*by, "weight", F.explode("cells").alias("cell")))
    return cells.groupBy(*by, F.col("cell.i").alias("i")).agg(F.sum(F.col("weight") * F.col("cell.v")).alias("s")).collect()


def lloyd(rows: DataFrame, centres: list[list[float]], rounds: int) -> DataFrame:
    """Distinct vectors (cached by the caller) with ``cluster_id`` after ``rounds`` assignments, or
    fewer when one changes nothing.  As in the reference every vector counts as in cluster 0 before."""
    k, m = len(centres), len(centres[0])
    sums, counts = [[0.0] * m for _ in range(k)], [0.0] * k
    state, moved = None, None
    for _ in range(rounds):
        after = checkpointed(_assigned(rows, state, centres, moved))  # a few numbers for each vector
        deltas = _sums(rows, after.where(F.col("cluster_id") != F.col("before")), ["before", "cluster_id"])
        state = after
        if not any(max(r["before"], 0) != r["cluster_id"] for r in deltas):
            break
        for r in deltas:
            for c, sign in ((r["cluster_id"], 1), (r["before"], -1)):
                if c >= 0 and r["i"] >= 0:
                    sums[c][r["i"]] += sign * r["s"]
                elif c >= 0:
                    counts[c] += sign * r["s"]
        new = [[v / n for v in s] if n > 0 else c for s, n, c in zip(sums, counts, centres)]
        moved = [math.dist(a, b) for a, b in zip(centres, new)]
        centres = new
    return state


def _start(vectors: DataFrame, k: int, start: str) -> list[list[float]]:
    """Vectors of the k starting posts."""
    if start == "first":
        vectors = vectors.where(F.exists(F.unwrap_udt("features")["values"], lambda x: x != 0))
        order = [F.col("tweet_id").cast("long"), F.col("tweet_id")]
    else:
        order = [F.xxhash64("tweet_id", "features", F.lit(SEED)), F.col("tweet_id")]
    return [r["features"].toArray().tolist() for r in vectors.orderBy(*order).limit(k).collect()]


class Clusters:
    """Result of :func:`kmeans`: distinct vectors, their state, k and the vocabulary."""

    def __init__(self, vectors: DataFrame, rows: DataFrame, state: DataFrame, k: int, words: list[str]) -> None:
        self.vectors, self.rows, self.state, self.k, self.words = vectors, rows, state, k, words

    def assigned(self) -> DataFrame:
        """The posts' vectors with their ``cluster_id``."""
        return self.vectors.join(self.state.select(*_ID, "cluster_id").hint("shuffle_hash"), _ID).drop(*_ID)

    def sums(self) -> list:
        return _sums(self.rows, self.state, ["cluster_id"])


def kmeans(posts: DataFrame, arrays: DataFrame, k: int = 4, max_features: int = 200,
           max_iter: int = 15, start: str = "random") -> Clusters | None:
    """None when there is no vocabulary or fewer than two posts."""
    vectors, words, _, n = tfidf_vectors(posts, arrays, max_features)
    if vectors is None or n < 2:
        return None
    k = max(2, min(int(k), n))
    return _clustered(vectors, k, max(int(max_iter), 1), start, words)


def _clustered(vectors: DataFrame, k: int, rounds: int, start: str, words: list[str]) -> Clusters:
    vectors = materialize(_with_id(vectors))  # read for the start, the distinct rows and the result
    rows = materialize(_distinct_vectors(vectors))
    centres = _start(vectors, k, start)
    centres += [centres[0]] * (k - len(centres))  # fewer starting posts than clusters: the others stay empty
    return Clusters(vectors, rows, lloyd(rows, centres, rounds), k, words)


def lloyd_from_first(vectors: DataFrame, k: int, rounds: int) -> DataFrame:
    """``vectors`` (tweet_id, features) with ``cluster_id`` after ``rounds`` assignments from
    the first k posts (numeric id) with a vector other than zero."""
    return _clustered(vectors, k, rounds, "first", []).assigned()


def kmeans_clusters(posts: DataFrame, arrays: DataFrame, k: int = 4, max_features: int = 200,
                    max_iter: int = 15, start: str = "random"):
    """(assigned[tweet_id, features, cluster_id], k_used, vocabulary) or None when
    there is no vocabulary or fewer than two posts."""
    res = kmeans(posts, arrays, k, max_features, max_iter, start)
    return None if res is None else (res.assigned(), res.k, res.words)


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    spark = assigned.sparkSession
    base = spark.range(k).select(F.col("id").cast("int").alias("cluster_id"))
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return (F.broadcast(base).join(sizes, "cluster_id", "left")
            .select("cluster_id", F.coalesce("size", F.lit(0)).alias("size")).orderBy("cluster_id"))


def kmeans_cluster_summary(posts: DataFrame, arrays: DataFrame, k: int = 4, max_features: int = 200,
                           max_iter: int = 15, start: str = "random") -> DataFrame:
    """cluster_id, size, top_terms (up to 8 words with positive summed weight, ', ' joined)."""
    spark = posts.sparkSession
    res = kmeans(posts, arrays, k, max_features, max_iter, start)
    if res is None:
        return spark.createDataFrame([], "cluster_id int, size bigint, top_terms string")
    cells = spark.createDataFrame([tuple(r) for r in res.sums()], "cluster_id int, i int, w double")  # k * max_features rows
    base = spark.range(res.k).select(F.col("id").cast("int").alias("cluster_id"))
    sizes = cells.where("i = -1").select("cluster_id", F.col("w").cast("long").alias("size"))
    vocab = F.array(*[F.lit(w) for w in res.words])
    w = Window.partitionBy("cluster_id").orderBy(F.desc(C.round_half_up(F.col("w"), 4)), F.asc("i"))
    top = (cells.where("i >= 0 AND w > 0").withColumn("token", F.get(vocab, F.col("i")))
           .withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 8)
           .groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rn", "token"))).alias("t"))
           .select("cluster_id", F.array_join(F.transform("t", lambda s: s["token"]), ", ").alias("top_terms")))
    return (base.join(sizes, "cluster_id", "left").join(top, "cluster_id", "left")
            .select("cluster_id", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("top_terms", F.lit("")).alias("top_terms"))
            .orderBy("cluster_id"))
