"""Connected components of a graph given as edges, by alternating stars.

Every partition first replaces its edges by links to the smallest node it can reach
with them, which keeps connectivity and shortens paths.  Then large and small star
steps link each node to smaller ones until nothing changes.  Each step is a partial
aggregation and a join on the node, so a node with very many edges is split by
adaptive skew handling; lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import checkpointed, released, ship


def _contract(edges: DataFrame) -> DataFrame:
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        kinds = None
        for b in batches:
            kinds = b.schema.types
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                up.setdefault(u, u)
                up.setdefault(v, v)
                a, c = root(u), root(v)
                if a != c:
                    up[max(a, c)] = min(a, c)
        if kinds:
            links = [(x, root(x)) for x in up]
            links = [x for x in links if x[0] != x[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], kinds[0]), pa.array([x[1] for x in links], kinds[1])], names=["u", "v"])

    return edges.mapInArrow(released(run), f"u {kind}, v {kind}")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node but the roots, the smallest nodes of their components.

    ``edges`` has two columns of one orderable type; loops and repeated edges are
    harmless, edges with a null end are ignored.
    """
    ship(edges.sparkSession)
    a, b = edges.columns
    e = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    e = checkpointed(_contract(e.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))).distinct())
    before = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
