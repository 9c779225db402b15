"""Prefix trie of conversations: ternary search trees per range shard, merged at the borders.

A conversation is the sequence of its turns by turn number (null first; turns of one
number by role and digest), each a (role, text) pair with nulls as empty.  Every distinct sequence of first
turns is a node, from the textless root down; the conversations that start with it are
its members.

1. A turn becomes 128 bits of the SHA-256 of role and text as it is read, so texts are
   never shuffled; a conversation becomes one row, its path (16 bytes a turn) and the
   words of each turn.
2. Equal paths become one row: counts, smallest id, and the digest of the ids that end
   there.  Ids are listed in pieces that agree above ``ID_BITS``, which are spread, and
   the digest, which is sequential by nature, reads the pieces one at a time.
3. Distinct paths are sorted into ranges, and each range is read as shards of about
   ``SHARD_TURNS`` turns.  A shard encodes its turns by a dictionary, in order, and inserts
   its paths into a ternary search tree, the median first, then the medians of both halves,
   so the tree over the children of any node stays balanced.  A loop without recursion
   over the nodes from the deepest up accumulates members, leaves and savings.
4. Only nodes on the first and the last path of a shard can go on in another shard.  Those
   borders, two paths of each shard and in order, are merged by one pass that keeps the
   nodes of one path at a time; all other nodes are final.

Defined results: rows without conv_id belong to no conversation and are left out; an id
given twice is one conversation with all its rows; rows that repeat are turns that repeat;
a null turn comes first; other columns are not read; an empty table gives no nodes.  A
conversation is one row, so its turns (16 bytes each, not its texts) have to fit in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .cluster import checkpointed, released, ship
from .sqltext import crc32_sql

KEY = 16                   # bytes of a turn's key
SHARD_TURNS = 1 << 18      # turns of a shard: bounds the memory of its tree, not the result
ID_BITS = 8                # ids that differ in these bits make a piece of a list of ids: bounds a group, not the result
HEAD = 3                   # most turns that a rebuilt conversation can take from another
FAMILY = 20                # conversations c - c % FAMILY to the next multiple share their first turns

_WORD = r"[^\x20\x09-\x0D]+"

_NODE = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_SHARD_SCHEMA = f"shard long, side int, key binary, parent_key binary, parent_conv_id long, words long, {_NODE}"


def turn_key(role: Column, text: Column) -> Column:
    """128 bits of the digest; the length of the role keeps role and text apart."""
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, path (keys of its turns, hex) and words of each turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_key(role, text).alias("key"),
        F.size(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))).cast("long").alias("words"))
    # A family meets in one partition, so its conversations need no second exchange.
    grouped = (rows.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).repartition("family")
               .groupBy("family", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "key", "words"))).alias("t")))
    return grouped.select("family", "conv_id", F.col("t.key").alias("keys"), F.col("t.words").alias("words"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Paths where the first h turns of c, h = crc32(c) % 4, are those of c - c % FAMILY (all
    if it has fewer, none if it is absent)."""
    first = F.when(F.col("conv_id") == F.col("family"), F.struct(*(F.slice(c, 1, HEAD).alias(c) for c in ("keys", "words"))))
    with_head = (paths(turns).withColumn("head", F.max(first).over(Window.partitionBy("family")))
                 .withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).cast("int")))

    def joined(c: str) -> Column:
        lent = F.coalesce(F.expr(f"slice(head.{c}, 1, h)"), F.expr(f"slice({c}, 1, 0)"))
        return F.concat(lent, F.expr(f"slice({c}, h + 1, greatest(size({c}) - h, 0))"))

    return with_head.select("conv_id", joined("keys").alias("keys"), joined("words").alias("words"))


def plain(turns: DataFrame) -> DataFrame:
    """Paths of the conversations as they are."""
    return paths(turns).select("conv_id", "keys", "words")


def distinct_paths(convs: DataFrame) -> DataFrame:
    """path (bytes), words, n, least id and the digest of all ids of each distinct path."""
    keyed = convs.select("conv_id", F.unhex(F.array_join("keys", "")).alias("path"), "words")
    pieces = (keyed.groupBy("path", F.shiftright("conv_id", ID_BITS).alias("block"))
              .agg(F.first("words").alias("words"), F.array_sort(F.collect_list("conv_id")).alias("ids"))
              .select("path", "block", "words", F.size("ids").cast("long").alias("n"), F.col("ids")[0].alias("least"), F.array_join("ids", ",").alias("listed")))
    return (pieces.repartition("path").sortWithinPartitions("path", "block")
            .mapInArrow(released(_digested), "path binary, words array<long>, n long, least long, ends string"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as one row for each path; a list is never put together."""
    names = ["path", "words", "n", "least", "ends"]
    types = [pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]
    open_row, sha = None, None
    for b in batches:
        out = []
        rows = (b.column(i).to_pylist() for i in (0, 2, 3, 4))
        for (path, words, n, least), listed in zip(zip(*rows), b.column(5)):
            if open_row is not None and path == open_row[0]:
                sha.update(b",")
                open_row[2] += n
            else:
                if open_row is not None:
                    out.append((*open_row, sha.hexdigest()))
                open_row, sha = [path, words, n, least], hashlib.sha256()
            sha.update(listed.as_py().encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
    if open_row is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*open_row, sha.hexdigest()), types)], names=names)


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1: the median, then both halves likewise."""
    spans = [(0, n)]
    while spans:
        lo, hi = spans.pop()
        if lo < hi:
            mid = (lo + hi) // 2
            yield mid
            spans += [(mid + 1, hi), (lo, mid)]


class Ternary:
    """A ternary search tree over turn codes; its nodes are the trie's, 0 the root.

    ``down`` leads to the search tree over a node's children, ``lower`` and ``higher`` to
    the siblings with smaller and greater codes.  A node's number is greater than its parent's.
    """

    def __init__(self) -> None:
        self.code, self.parent, self.depth = [-1], [-1], [0]
        self.down, self.lower, self.higher = [-1], [-1], [-1]

    def child(self, node: int, code: int) -> int:
        """The child of ``node`` with ``code``, added if missing."""
        links, at = self.down, node
        while links[at] >= 0:
            at = links[at]
            if code == self.code[at]:
                return at
            links = self.lower if code < self.code[at] else self.higher
        new = links[at] = len(self.code)
        self.code.append(code)
        self.parent.append(node)
        self.depth.append(self.depth[node] + 1)
        for link in (self.down, self.lower, self.higher):
            link.append(-1)
        return new

    def insert(self, codes: list[int]) -> list[int]:
        """The nodes along a path, without the root."""
        node, out = 0, []
        for code in codes:
            node = self.child(node, code)
            out.append(node)
        return out


NOTHING = hashlib.sha256(b"").hexdigest()


def shard_rows(number: int, rows: list[tuple[bytes, np.ndarray, int, int, str]]) -> pa.RecordBatch:
    """Nodes of the trie over distinct sorted paths (path, words, n, least, ends).

    Border nodes have side 0 (first path) or 1 (last path) and sums over what hangs below
    them off the border; a final node has side 2, or 3 where its parent is a border node.
    """
    split = [[path[k:k + KEY] for k in range(0, len(path), KEY)] for path, *_ in rows]
    codes = {key: i for i, key in enumerate(sorted({key for keys in split for key in keys}))}
    tree = Ternary()
    walked: list[list[int]] = [[]] * len(rows)
    for r in medians_first(len(rows)):
        walked[r] = tree.insert([codes[key] for key in split[r]])
    size = len(tree.code)
    words, ends = [0] * size, [None] * size
    members, least = [0] * size, [None] * size
    for (_, w, n, first, listed), nodes in zip(rows, walked):
        for node, count in zip(nodes, w):
            words[node] = int(count)
        top = nodes[-1] if nodes else 0
        members[top], least[top], ends[top] = n, first, listed
    sides = [2] * size
    for side, nodes in ((1, walked[-1]), (0, walked[0])):
        for node in [0, *nodes]:
            sides[node] = side
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):  # children come before their parent
        up = tree.parent[node]
        border = sides[node] < 2
        if not border:
            leaves[node] += children[node] == 0
            saved[node] += (members[node] - 1) * words[node]
        if up < 0:
            continue
        members[up] += members[node]
        if least[up] is None or least[node] < least[up]:
            least[up] = least[node]
        if not border:
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            if sides[up] < 2:
                sides[node] = 3
    keys: list[bytes | None] = [None] * size
    for r in (0, -1):  # keys of border nodes: chained, so a key stands for its whole sequence
        chain = hashlib.sha256(b"root").digest()
        keys[0] = chain
        for node, key in zip(walked[r], split[r]):
            chain = keys[node] = hashlib.sha256(chain + key).digest()
    parents = [keys[p] if p >= 0 and s != 2 else None for p, s in zip(tree.parent, sides)]
    above = [least[p] if p >= 0 and s == 2 else None for p, s in zip(tree.parent, sides)]
    columns = [pa.array([number] * size, pa.int64()), pa.array(sides, pa.int32()), pa.array(keys, pa.binary()), pa.array(parents, pa.binary()),
               pa.array(above, pa.int64()), *(pa.array(c, pa.int64()) for c in (words, least, tree.depth, members, children, leaves, saved)),
               pa.array([e or (NOTHING if s > 1 else None) for e, s in zip(ends, sides)], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "side", "key", "parent_key", "parent_conv_id", "words", "conv_id", "depth", "n_convs",
                                                      "n_children", "n_leaves", "saved_tokens", "ends_sha256"])


def sharded(distinct: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of all shards: distinct paths in ranges, each read as shards of consecutive paths."""
    ship(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32  # ranges ascend with partitions
        rows, held = [], 0
        for b in batches:
            flat, ptr = b.column(1).flatten().to_numpy(zero_copy_only=False), b.column(1).offsets.to_numpy()
            ptr = ptr - ptr[0]
            for i, (path, n, least, listed) in enumerate(zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)))):
                rows.append((path, flat[ptr[i]:ptr[i + 1]].copy(), n, least, listed))
                held += len(path) // KEY + 1
                if held >= shard_turns:
                    yield shard_rows(number, rows)
                    number, rows, held = number + 1, [], 0
        if rows:
            yield shard_rows(number, rows)

    return distinct.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(released(run), _SHARD_SCHEMA)


class _Border:
    """A border node that is still open: sums over the shards so far."""

    __slots__ = ("key", "parent_key", "shards", "row")

    def __init__(self, r: dict) -> None:
        self.key, self.parent_key, self.shards, self.row = r["key"], r["parent_key"], [], r

    def add(self, r: dict) -> None:
        mine = self.row
        for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
            mine[c] += r[c]
        mine["conv_id"] = min(mine["conv_id"], r["conv_id"])
        mine["ends_sha256"] = mine["ends_sha256"] or r["ends_sha256"]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border rows by shard, side and depth, hence in order of their paths, as whole nodes.

    ``open_`` holds the nodes of one path.  A node is closed when a path leaves it, with
    one row for each shard that has it, and adds its sums to its parent.  Within a shard
    the last path lists only nodes that the first has not.
    """
    open_: list[_Border] = []
    done: list[tuple] = []

    def close() -> None:
        node = open_.pop()
        r = node.row
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        if open_:
            up = open_[-1].row
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
        done.extend((s, node.key, node.parent_key, r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
                     r["ends_sha256"] or NOTHING, s == node.shards[0]) for s in node.shards)

    def batch() -> pa.RecordBatch:
        types = [pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.bool_()]
        cols = [pa.array(c, t) for c, t in zip(zip(*done), types)]
        done.clear()
        return pa.RecordBatch.from_arrays(cols, names=["shard", "key", "parent_key", "conv_id", "depth", "n_convs", "n_children", "n_leaves",
                                                       "saved_tokens", "ends_sha256", "own"])

    for b in batches:
        for r in b.to_pylist():
            while len(open_) > r["depth"] and open_[r["depth"]].key != r["key"]:
                close()
            if len(open_) > r["depth"]:
                open_[r["depth"]].add(r)
            else:
                open_.append(_Border(r))
            open_[r["depth"]].shards.append(r["shard"])
            if len(done) >= 1 << 14:
                yield batch()
    while open_:
        close()
    if done:
        yield batch()


def trie(convs: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256."""
    nodes = checkpointed(sharded(checkpointed(distinct_paths(convs)), shard_turns))
    # Two paths of each shard: rows by shards, not by conversations.
    border = (nodes.where("side < 2").drop("parent_conv_id").repartition(1).sortWithinPartitions("shard", "side", "depth")
              .mapInArrow(_merged, f"shard long, key binary, parent_key binary, {_NODE}, own boolean"))
    border = checkpointed(border)
    columns = ["depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    # A border node looks its parent up in its first shard, which has the parent too.
    waiting = (nodes.where("side = 3").select("shard", "parent_key", "conv_id", *columns)
               .unionByName(border.where("own").select("shard", "parent_key", "conv_id", *columns)))
    parents = border.select(F.col("shard").alias("in_shard"), F.col("key").alias("in_key"), F.col("conv_id").alias("parent_conv_id"))
    found = waiting.join(parents, (F.col("shard") == F.col("in_shard")) & (F.col("parent_key") == F.col("in_key")), "left")
    out = ["conv_id", "depth", "parent_conv_id", *columns[1:]]
    return nodes.where("side = 2").select(*out).unionByName(found.select(*out))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE_SQL = rf"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
      sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS family, {crc32_sql("conv_id::VARCHAR")} % {HEAD + 1} AS h FROM turns),
heads AS (SELECT c.conv_id, t.k AS pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.family WHERE t.k <= c.h),
n_heads AS (SELECT c.conv_id, c.h, count(e.conv_id) AS n FROM convs c LEFT JOIN heads e USING (conv_id) GROUP BY c.conv_id, c.h),
built AS (SELECT * FROM heads UNION ALL
  SELECT t.conv_id, t.k - n.h + n.n, t.role, t.text FROM turns t JOIN n_heads n USING (conv_id) WHERE t.k > n.h),
steps AS (SELECT conv_id, pos, len(regexp_extract_all(text, '{_WORD}')) AS words,
    string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path,
    count(*) OVER (PARTITION BY conv_id) AS turns FROM built),
members AS (SELECT conv_id, pos AS depth, path, words, turns = pos AS ends FROM steps
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM built) FROM n_heads),
nodes AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM members GROUP BY depth, path),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, count(c.path) AS n_children FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * (n.depth - 1))
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND left(c.path, 64 * n.depth) = n.path GROUP BY ALL),
below AS (SELECT unnest(range(0, depth + 1)) AS top, path, n_children, (n_convs - 1) * words AS saved FROM linked),
sums AS (SELECT top AS depth, left(path, 64 * top) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM below GROUP BY ALL)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN sums USING (depth, path)
"""
