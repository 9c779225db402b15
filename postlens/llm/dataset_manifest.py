"""Merkle manifest of a dataset: levels stored every ``STRIDE``, proofs by recomputing the rest.

A row's leaf is the SHA-256 (lowercase hex) of its fields, each ``-`` if null, else its
UTF-8 byte count, ``:`` and its value.  Leaves of a language ascend by id; while there
are several nodes, every ``FANOUT`` consecutive ones become the digest of their hex
texts, down to the language's subroot.  Subroots, by language, give the root likewise.

Checkpoint and recompute: only levels 0, 3, 6, ... are written (to the cluster's shared
folder), as *blocks* of ``FANOUT ** STRIDE`` = 512 consecutive nodes of a tree.  A block
is an aligned subtree: it gives one node of the next stored level, and a proof needs, of
each stored level, only the block that holds its node.  Extraction runs from the top
down.  For each block it computes the levels between again, writes the siblings of each
of its nodes after those of the block's own node, and keeps nothing of them.

All work on rows is in built-in functions.  A block's 512 nodes are the largest group;
nothing is grouped by language, so a language with most rows is spread like the rest.

Defined results: equal ids of a language stand in order of their leaves and a null id
comes first; a null language is a language of its own and comes first; rows that agree
in all fields stay separate leaves with the same digest; other columns are not read; an
empty table gives no rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import checkpointed
from .sqltext import crc32_sql

FANOUT = 8
STRIDE = 3
BLOCK = FANOUT ** STRIDE

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def leaf_of(fields: list[Column]) -> Column:
    """Length-prefixed fields, so that no two rows of different fields give the same input."""
    texts = [f.cast("string") for f in fields]
    return digest(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)))


class Manifest(NamedTuple):
    """``stored[t]``: blocks (tree, block, m, nodes) of level ``t * STRIDE``, m being the
    tree's nodes on that level; ``tops``: tree and the digest that remains of it."""

    stored: list[DataFrame]
    tops: DataFrame


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place within the tree from 0, and ``m``, its rows.

    Ranges of (tree, order) are sorted apart and checkpointed; a row's place is that in
    its range plus the rows of the tree in the ranges before, of which there are no more
    than ranges and trees together.  Rows that are equal in all of these are told apart
    by their place in the first checkpoint, so that ranges can divide them too.
    """
    kept = checkpointed(rows).withColumn("copy", F.monotonically_increasing_id())
    keys = [F.col(c).asc_nulls_first() for c in [tree, *order, "copy"]]
    # `at` is the partition's number above 33 bits that count its rows.
    ranged = checkpointed(kept.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("copy")
                          .withColumn("at", F.monotonically_increasing_id())
                          .withColumn("part", F.shiftright("at", 33)))
    runs = (ranged.groupBy("part", F.col(tree).alias("run_tree")).agg(F.min("at").alias("first"), F.count("*").alias("size"))
            .withColumn("m", F.expr("sum(size) OVER (PARTITION BY run_tree)"))
            .withColumn("base", F.expr("sum(size) OVER (PARTITION BY run_tree ORDER BY part) - size - first"))
            .withColumnRenamed("part", "run_part").drop("first", "size"))
    return (ranged.join(runs, (F.col("part") == F.col("run_part")) & F.col(tree).eqNullSafe(F.col("run_tree")))
            .withColumn("idx", F.col("at") + F.col("base"))
            .drop("at", "part", "run_part", "run_tree", "base"))


def _above(level: Column) -> Column:
    """The next level of a block: the digest of every FANOUT nodes; empty stays empty."""
    runs = F.floor((F.size(level) + F.lit(FANOUT - 1)) / F.lit(FANOUT)).cast("int")
    return F.transform(F.sequence(F.lit(0), runs - 1),
                       lambda i: digest(F.array_join(F.slice(level, i * FANOUT + 1, F.lit(FANOUT)), "")))


def _height(m: Column) -> Column:
    """Levels that a block of a tree with ``m`` nodes climbs: STRIDE, or fewer up to the top."""
    out = F.lit(STRIDE)
    for h in reversed(range(STRIDE)):
        out = F.when(m <= FANOUT ** h, h).otherwise(out)
    return out


def _with_levels(blocks: DataFrame, nodes: Column) -> DataFrame:
    """Columns l0 to l<STRIDE>: the levels of each block, repeated above the tree's top."""
    out = blocks.withColumn("l0", nodes).withColumn("height", _height(F.col("m")))
    for h in range(1, STRIDE + 1):
        out = out.withColumn(f"l{h}", F.when(F.col("height") >= h, _above(F.col(f"l{h - 1}"))).otherwise(F.col(f"l{h - 1}")))
    return out


def _blocks(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """Nodes (tree, idx, m, digest, payload) as one row for each block, nodes in order."""
    return (nodes.groupBy("tree", F.floor(F.col("idx") / BLOCK).alias("block"))
            .agg(F.max("m").alias("m"), F.array_sort(F.collect_list(F.struct("idx", "digest", *payload))).alias("nodes")))


def build(leaves: DataFrame, payload: list[str]) -> Manifest:
    """The stored levels over leaves (tree, idx, m, digest and ``payload``, which stays with the leaves)."""
    stored = [checkpointed(_blocks(leaves, payload))]
    while True:
        last = stored[-1]
        highest = last.agg(F.max("m")).head()[0]
        if highest is None or highest <= 1:
            return Manifest(stored, last.select("tree", F.col("nodes")[0]["digest"].alias("top")))
        up = _with_levels(last, F.col("nodes.digest"))
        above = up.select("tree", F.col("block").alias("idx"), F.ceil(F.col("m") / BLOCK).alias("m"), F.col(f"l{STRIDE}")[0].alias("digest"))
        stored.append(checkpointed(_blocks(above, [])))


def _siblings(level: Column, pos: Column) -> Column:
    """The other nodes of the run that holds ``pos``, as text left and right of it."""
    start = F.floor(pos / FANOUT).cast("int") * FANOUT
    place = (pos - start).cast("int")
    return F.struct(F.array_join(F.slice(level, start + 1, place), "").alias("left"),
                    F.array_join(F.slice(level, pos.cast("int") + 2, F.lit(FANOUT - 1) - place), "").alias("right"))


def proofs(manifest: Manifest, payload: list[str], base: DataFrame | None = None) -> DataFrame:
    """Each leaf (tree, digest, payload) with ``proof``, the siblings of every level as
    (left, right) text from the leaf up, and ``said``.

    ``base`` gives (tree, base, said): what the proof of each tree's top goes on with, and
    a value that comes down to all leaves of the tree.  To prove a few leaves, filter the
    blocks of ``manifest.stored[0]``: of the levels above only the blocks that they meet in
    the joins are computed again.
    """
    above = None
    for t in reversed(range(len(manifest.stored))):
        blocks = _with_levels(manifest.stored[t], F.col("nodes.digest"))
        if above is not None:
            blocks = blocks.join(above, blocks["tree"].eqNullSafe(above["above_tree"]) & (blocks["block"] == above["above_idx"]))
        elif base is not None:  # on the highest stored level a tree is one block
            blocks = blocks.join(base.select(F.col("tree").alias("above_tree"), F.col("base").alias("upper"), "said"), F.col("tree").eqNullSafe(F.col("above_tree")))
        else:
            blocks = blocks.withColumn("upper", F.expr("cast(array() as array<struct<left:string,right:string>>)")).withColumn("said", F.lit(None))
        own = F.transform("nodes", lambda n, i: F.struct(n.alias("node"), F.concat(
            F.slice(F.array(*(_siblings(F.col(f"l{h}"), F.floor(i / FANOUT ** h)) for h in range(STRIDE))), F.lit(1), F.col("height")),
            F.col("upper")).alias("proof")))
        rows = blocks.select("tree", "said", F.explode(own).alias("x"))
        above = rows.select(F.col("tree").alias("above_tree"), F.col("x.node.idx").alias("above_idx"), F.col("x.proof").alias("upper"), "said")
    return rows.select("tree", "said", F.col("x.node.digest").alias("digest"), *(F.col(f"x.node.{c}").alias(c) for c in payload), F.col("x.proof").alias("proof"))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return digest(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))


def audited(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root and proof_sha256 of every row, and whether its present
    text still proves: rows where ``tampered`` (over FIELDS) holds have their text's A-Z
    in lower case when the root is folded, from the original siblings."""
    rows = docs.select("doc_id", "source", "lang", "n_chars", F.col("text").cast("string").alias("text"))
    changed = [F.translate("text", _UPPER, _UPPER.lower()) if c == "text" else F.col(c) for c in FIELDS]
    leaves = rows.select(F.col("lang").cast("string").alias("tree"), "doc_id", leaf_of([F.col(c) for c in FIELDS]).alias("digest"),
                         F.when(tampered, leaf_of(changed)).alias("present"))
    forest = build(numbered(leaves, "tree", ["doc_id", "digest"]), ["doc_id", "present"])
    tops = forest.tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("top").alias("digest"))
    crown = build(numbered(tops, "tree", ["lang"]), ["lang"])
    root = crown.tops.head()  # one digest, or none of an empty table
    bases = proofs(crown, ["lang"]).select(F.col("lang").alias("tree"), F.col("proof").alias("base"), F.struct(
        F.col("digest").alias("subroot"), F.lit(root["top"] if root else None).cast("string").alias("root")).alias("said"))
    return (proofs(forest, ["doc_id", "present"], checkpointed(bases))
            .withColumn("folded_root", folded(F.coalesce("present", "digest"), F.col("proof")))
            .select("doc_id", F.col("digest").alias("leaf"), "said.subroot", "said.root", proof_digest(F.col("proof")).alias("proof_sha256"),
                    "folded_root", (F.col("folded_root") == F.col("said.root")).alias("verified")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return audited(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False)))


_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS) + ")"
_PRESENT = "sha256(" + " || ".join(_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if c == "text" else c) for c in FIELDS) + ")"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes of the trees over ``leaves`` (tree, idx, m, digest), level by level."""
    return f"""{name} AS (SELECT tree, 0 AS lvl, idx, m, digest FROM {leaves}
  UNION ALL SELECT tree, lvl + 1, idx // {FANOUT}, any_value((m + {FANOUT - 1}) // {FANOUT}), sha256(string_agg(digest, '' ORDER BY idx))
  FROM {name} WHERE m > 1 GROUP BY tree, lvl, idx // {FANOUT})"""


def _siblings_sql(name: str, nodes: str) -> str:
    """Of every node below a top: digests left and right of it in its run."""
    return f"""{name} AS (SELECT n.tree, n.lvl, n.idx,
  coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx < n.idx), '') AS l,
  coalesce(string_agg(s.digest, '' ORDER BY s.idx) FILTER (WHERE s.idx > n.idx), '') AS r
  FROM {nodes} n JOIN {nodes} s ON s.tree = n.tree AND s.lvl = n.lvl AND s.idx // {FANOUT} = n.idx // {FANOUT}
  WHERE n.m > 1 GROUP BY n.tree, n.lvl, n.idx)"""


ORACLE_SQL = f"""
WITH RECURSIVE rows AS (SELECT *, coalesce('=' || lang, '') AS tree, {_LEAF} AS digest,
    CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_PRESENT} END AS present FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS m FROM rows),
{_tree_sql("nodes", "leaves")},
tops AS (SELECT '' AS tree, tree AS lang, lvl, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS m FROM nodes WHERE m = 1),
{_tree_sql("crown", "tops")},
{_siblings_sql("beside", "nodes")},
{_siblings_sql("beside_tops", "crown")},
steps AS (
  SELECT f.tree, f.idx, b.lvl, b.l, b.r FROM leaves f JOIN beside b ON b.tree = f.tree AND b.idx = f.idx // ({FANOUT} ** b.lvl)::BIGINT
  UNION ALL SELECT f.tree, f.idx, t.lvl + b.lvl, b.l, b.r FROM leaves f JOIN tops t ON t.lang = f.tree JOIN beside_tops b ON b.idx = t.idx // ({FANOUT} ** b.lvl)::BIGINT),
folds AS (SELECT tree, idx, 0 AS lvl, coalesce(present, digest) AS acc FROM leaves
  UNION ALL SELECT f.tree, f.idx, f.lvl + 1, sha256(s.l || f.acc || s.r) FROM folds f JOIN steps s ON s.tree = f.tree AND s.idx = f.idx AND s.lvl = f.lvl),
ends AS (SELECT tree, idx, arg_max(acc, lvl) AS folded_root FROM folds GROUP BY tree, idx),
proofs AS (SELECT tree, idx, sha256(string_agg(l || r, '' ORDER BY lvl)) AS proof_sha256 FROM steps GROUP BY tree, idx),
root AS (SELECT digest AS root FROM crown WHERE m = 1)
SELECT f.doc_id, f.digest AS leaf, t.digest AS subroot, root.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  e.folded_root, e.folded_root = root.root AS verified
FROM leaves f JOIN tops t ON t.lang = f.tree JOIN ends e ON e.tree = f.tree AND e.idx = f.idx
LEFT JOIN proofs p ON p.tree = f.tree AND p.idx = f.idx, root
"""
