"""Mix sources to target weights through a multivariate-hypergeometric splitting tree.

The unit of the mix is a block: the documents of one source whose hash falls into one
of ``ceil(size / block_words)`` equal ranges, so blocks are small, random and alike at
every size of the input.  A source contributes whole epochs of its blocks, and of the
last epoch blocks in permuted order up to its target; the block at the edge is taken
document by document, and one more document closes most of the rest.

Output shards are the leaves of a binary tree.  Every node splits the exact numbers
of blocks of its sources between its halves by a multivariate-hypergeometric draw
seeded with the node's place, so a leaf finds its own quotas from the root without
talking to others and a recomputed task gets the same ones.  A leaf's quota of a
source is a range of the source's permuted blocks; ranges of different leaves are
disjoint and cover all blocks.  Inside a shard rows are shuffled by hash.

Sizes are numbers of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0).  Sources in
order of code point (null last) weigh 1, 2, 3, 1, 2, 3, ... and share all words;
none gets over ``MAX_EPOCHS`` times its size, the excess is shared by weight again.

Defined results: a null source is a source; texts without words are never taken;
repeated rows count as rows of their own and are taken alike; an empty table gives no
rows; extra columns pass through.  Memory: the table of sources (one row each) is the
only thing that reaches the driver and every leaf; ``MAX_SOURCES`` bounds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .cluster import checkpointed, released, ship

MAX_EPOCHS = 3
BLOCK_WORDS = 1 << 18
SHARD_BLOCKS = 8       # blocks of an output shard, about
MAX_SOURCES = 100_000  # more raise an error; a mix is planned by source
GROUP = 1024           # blocks of a prefix-sum group

_WORD = r"[^\x20\x09-\x0D]++"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def targets(sizes: np.ndarray, weights: np.ndarray, cap: int = MAX_EPOCHS) -> np.ndarray:
    """Shares of ``sizes.sum()`` by weight; what exceeds ``cap * size`` is shared again."""
    limit = cap * sizes.astype(float)
    out = np.zeros(len(sizes))
    free = sizes > 0
    rest = float(sizes.sum())
    while free.any():
        share = rest * weights / weights[free].sum()
        over = free & (share >= limit)
        if not over.any():
            out[free] = share[free]
            break
        out[over] = limit[over]
        rest -= float(limit[over].sum())
        free &= ~over
    return out


def _draw(rng: np.random.Generator, counts: np.ndarray, take: int) -> np.ndarray:
    """Multivariate hypergeometric: how many of each kind are among ``take`` blocks."""
    out = np.zeros_like(counts)
    left, total = take, int(counts.sum())
    for i in np.flatnonzero(counts):
        c = int(counts[i])
        total -= c
        if not left:
            break
        out[i] = min(left, c) if total == 0 else rng.hypergeometric(c, total, left) if left < c + total else c
        left -= int(out[i])
    return out


def leaf_quotas(leaf: int, leaves: int, counts: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First permuted block and number of blocks that ``leaf`` gets of every source."""
    lo, hi = 0, leaves
    counts = counts.copy()
    first = np.zeros_like(counts)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(counts.sum())
        take = total * (mid - lo) // (hi - lo)
        left = _draw(np.random.default_rng([seed, lo, hi]), counts, take)
        if leaf < mid:
            hi, counts = mid, left
        else:
            first = first + left
            lo, counts = mid, counts - left
    return first, counts


def _hash(seed: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _unit(h: Column) -> Column:
    """A hash as a number in [0, 1) of 2**52 steps."""
    return F.shiftrightunsigned(h, 12) / F.lit(float(1 << 52))


def sized(docs: DataFrame, carry: list[str], seed: int = 9) -> DataFrame:
    """One row for each of ``docs``: the columns of ``carry`` packed in ``row``, source, size and a hash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col("source").alias("_source"),
                       n_words(F.col("text")).alias("size"), _hash(seed, "doc_id", F.xxhash64("text")).alias("_h"))


def plan(rows: DataFrame, narrow: DataFrame, seed: int = 9, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """The ``sized`` rows with source_size, target, taken and ``copies``, an array of
    (copy, shard, key) with one entry for each time the row is taken.

    ``narrow`` holds the same rows without the carried columns; the mix is planned on
    it, in several passes, and laid over ``rows`` in the last."""
    spark = rows.sparkSession
    ship(spark)
    kind = narrow.schema["_source"].dataType
    per_source = narrow.groupBy("_source").agg(F.sum("size").alias("source_size"))
    table = sorted(((r["_source"], r["source_size"]) for r in per_source.limit(MAX_SOURCES + 1).collect()),
                   key=lambda x: (x[0] is None, (x[0] or "").encode() if isinstance(x[0], str) or x[0] is None else x[0]))
    if len(table) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    sizes = np.array([x[1] for x in table], dtype=np.int64)
    target = targets(sizes, np.arange(len(table)) % 3 + 1.0)
    n_blocks = np.maximum(1, -(-sizes // block_words))
    epochs = np.where(sizes > 0, np.floor(target / np.maximum(sizes, 1)), 0).astype(int)
    rest = np.where(sizes > 0, np.rint(target).astype(np.int64) - epochs * sizes, 0)
    sources = spark.createDataFrame(
        [(i, s, int(sizes[i]), float(target[i]), int(n_blocks[i]), int(epochs[i]), max(0, int(rest[i]))) for i, (s, _) in enumerate(table)],
        T.StructType([T.StructField("_k", T.IntegerType()), T.StructField("_src", kind), T.StructField("source_size", T.LongType()),
                      T.StructField("target", T.DoubleType()), T.StructField("_blocks", T.LongType()),
                      T.StructField("_epochs", T.IntegerType()), T.StructField("_rest", T.LongType())]))
    # One row per source, at most MAX_SOURCES: small enough to broadcast.

    def in_blocks(x: DataFrame) -> DataFrame:
        return (x.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("_src"))).drop("_src", "_source")
                .withColumn("_b", F.floor(_unit(F.col("_h")) * F.col("_blocks"))))

    rows, narrow = in_blocks(rows), in_blocks(narrow)

    # Blocks: words, permuted order and where the last epoch ends.
    # The block at the edge is cut between documents: those whose running size, by hash,
    # ends inside; a closer runs on if its size is nearer to what is still missing.
    blocks = narrow.groupBy("_k", "_b").agg(F.sum("size").alias("_words"), F.first("_epochs").alias("_epochs"), F.first("_rest").alias("_rest"))
    blocks = blocks.withColumn("_p", F.row_number().over(Window.partitionBy("_k", F.floor(F.col("_b") / GROUP)).orderBy("_b")))
    blocks = blocks.withColumn("_g", F.floor(F.col("_b") / GROUP))
    in_group = Window.partitionBy("_k", "_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = blocks.groupBy("_k", "_g").agg(F.sum("_words").alias("_gw"), F.count("*").alias("_gn"))
    before = Window.partitionBy("_k").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_k", "_g", F.coalesce(F.sum("_gw").over(before), F.lit(0)).alias("_gw0"), F.coalesce(F.sum("_gn").over(before), F.lit(0)).alias("_gn0"))
    blocks = blocks.join(groups, ["_k", "_g"]).select(
        "_k", "_b", "_words", "_epochs", "_rest", (F.col("_gn0") + F.col("_p") - 1).alias("_pos"),
        (F.col("_gw0") + F.sum("_words").over(in_group)).alias("_end"))
    blocks = checkpointed(blocks)

    per = blocks.groupBy("_k").agg(F.count("*").alias("n"), F.first("_epochs").alias("e"),
                                   F.sum((F.col("_end") <= F.col("_rest")).cast("int")).alias("full"),
                                   F.max(F.when((F.col("_end") > F.col("_rest")) & (F.col("_end") - F.col("_words") < F.col("_rest")), 1).otherwise(0)).alias("edge")).collect()
    count = np.zeros(len(table), dtype=np.int64)   # block copies of each source
    for r in per:
        if sizes[r["_k"]] > 0:
            count[r["_k"]] = r["n"] * r["e"] + r["full"] + r["edge"]
    leaves = max(1, int(-(-count.sum() // shard_blocks)))

    def quotas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, int, int, int]] = []
            for leaf in b.column(0).to_pylist():
                first, n = leaf_quotas(leaf, leaves, count, seed)
                out += [(leaf, int(k), int(first[k]), int(n[k])) for k in np.flatnonzero(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["shard", "_k", "_first", "_n"])

    slots = (spark.range(leaves).mapInArrow(released(quotas), "shard long, _k long, _first long, _n long")
             .select("shard", "_k", F.explode(F.sequence("_first", F.col("_first") + F.col("_n") - 1)).alias("_slot")))

    # A source's block copies in permuted order: epoch after epoch, blocks by their random place.
    size_of = F.col("_n_blocks")
    n_of = blocks.groupBy("_k").agg(F.count("*").alias("_n_blocks"))
    copies = (blocks.where("_words > 0 or _epochs > 0").join(F.broadcast(n_of), "_k")
              .withColumn("_part", F.when(F.col("_end") <= F.col("_rest"), "full")
                          .when(F.col("_end") - F.col("_words") < F.col("_rest"), "edge").otherwise("none"))
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_epochs"))))
              .where((F.col("_copy") < F.col("_epochs")) | (F.col("_part") != "none"))
              .select("_k", "_b", "_copy", (F.col("_copy") * size_of + F.col("_pos")).alias("_slot"),
                      F.when((F.col("_copy") == F.col("_epochs")) & (F.col("_part") == "edge"),
                             F.col("_rest") - (F.col("_end") - F.col("_words"))).alias("_room")))
    placed = copies.join(slots, ["_k", "_slot"]).groupBy("_k", "_b").agg(
        F.sort_array(F.collect_list(F.struct("_copy", "shard"))).alias("_placed"),  # MAX_EPOCHS entries at most
        F.max("_room").alias("_room"), F.max("_copy").alias("_last"))

    # Documents of edge blocks (one block a source): which are inside.
    edge = narrow.join(placed.where("_room is not null"), ["_k", "_b"]).where("size > 0").select("_k", "_h", "size", "_room")
    order = Window.partitionBy("_k").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = edge.withColumn("_run", F.sum("size").over(order))
    fits = runs.groupBy("_k").agg(F.max(F.when(F.col("_run") <= F.col("_room"), F.col("_run"))).alias("_run"),
                                  F.max(F.when(F.col("_run") <= F.col("_room"), F.struct("_h", "size"))).alias("_upto"),
                                  F.first("_room").alias("_room_all"))
    gap = F.col("_room_all") - F.coalesce("_run", F.lit(0))
    closer = (edge.join(F.broadcast(fits.select("_k", gap.alias("_gap"), "_upto")), "_k")
              .where(F.col("_upto").isNull() | (F.struct("_h", "size") > F.col("_upto")))
              .groupBy("_k").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_gap")).alias("off"), "_h", "size", "_gap")).alias("_c"))
              .select("_k", F.when(F.col("_c.off") < F.col("_c._gap"), F.struct("_c._h", "_c.size")).alias("_closer")))
    cut = fits.select("_k", "_upto").join(closer, "_k", "left")

    me = F.struct("_h", "size")
    inside = F.col("_room").isNull() | F.coalesce(me <= F.col("_upto"), F.lit(False)) | F.coalesce(me == F.col("_closer"), F.lit(False))
    out = (rows.join(placed, ["_k", "_b"], "left").join(F.broadcast(cut), "_k", "left")
           .withColumn("_mine", F.when(F.col("size") == 0, F.array().cast(placed.schema["_placed"].dataType))
                       .otherwise(F.filter(F.coalesce("_placed", F.array().cast(placed.schema["_placed"].dataType)),
                                           lambda c: inside | (c["_copy"] < F.col("_last"))))))
    copies_col = F.transform("_mine", lambda c: F.struct(c["_copy"].alias("copy"), c["shard"].alias("shard"),
                                                         _hash(seed + 1, "_h", c["_copy"], c["shard"]).alias("key")))
    return out.select("row", "size", "source_size", "target", (F.size("_mine") * F.col("size")).cast("long").alias("taken"), copies_col.alias("copies"))


def mix(docs: DataFrame, seed: int = 9, **options) -> DataFrame:
    """The mixed rows with the columns of ``docs``: a row once for each time it is taken,
    every output shard in one partition and shuffled by hash."""
    narrow = checkpointed(sized(docs, [], seed).drop("row"))
    taken = plan(sized(docs, docs.columns, seed), narrow, seed, **options).select("row", F.explode("copies").alias("c"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return taken.repartition(n, "c.shard").sortWithinPartitions("c.shard", "c.key").select("row.*")


def planned(docs: DataFrame, seed: int = 9, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every document; one pass over the texts."""
    narrow = checkpointed(sized(docs, ["doc_id"], seed))
    return plan(narrow, narrow.drop("row"), seed, **options).select("row.doc_id", "size", "source_size", "target", "taken", "copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planned(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)
