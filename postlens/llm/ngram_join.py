"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters.

A document's set are the distinct shingles of ``WIDTH`` words, A-Z lower-cased (with
fewer words, the whole sequence as one).  Documents of equal sets form a class, which
is joined once.  Shingles are ordered by frequency, rarest first; two classes whose
Jaccard similarity reaches the threshold share a shingle of their prefixes, the first
``n - ceil(threshold * n) + 1``.  Frequencies come from a table of ``BUCKETS`` hashed
counters over the whole corpus: a fixed size, and any order of shingles that is the
same for all documents is exact.

Candidates are classes that share a prefix shingle and pass the length filter (sizes
in proportion), the positional filter (what is left behind the shared shingle must
suffice) and the suffix filter (shingles are parted by hash, and the differences of
the parts' sizes bound the overlap from above).  Each pair is verified once, on the
exact sets.

Groups stay linear where it matters: first every class is paired only with the pivot
of each prefix shingle, the class with most copies, and the verified links give
components.  Then only classes of different components are compared, in blocks, so a
large group of near copies is not expanded into its pairs, yet every link between
different components is found: the components are those of all links.

Defined results: a null or wordless text has an empty set, no links and its own id as
component; rows that share an id stay rows of their own; rows without an id take part
but never name a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textarrays as ta
from .cluster import checkpointed, released, ship
from .components import connected_components

WIDTH = 3
PERCENT = 90
STAGE_WIDTH = 5      # of the pipeline stage
STAGE_PERCENT = 80
BUCKETS = 1 << 22    # hashed frequency counters; 4 MB in every task
STEPS = 10           # of a counter, an octave
PARTS = 64           # of the suffix filter
BLOCK = 256          # classes of a block of the second round
HOT = 1 << 14        # a shingle counted more often is dealt over several tasks
SEEN = 1 << 20       # classes that a task remembers to have sent
FILTER_BITS = 1 << 23

_U = np.uint64


def _sets(s: ta.Slice, width: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of every text, ascending."""
    w = ta.words(s.buf, s.offsets)
    h = ta.span_hashes(s.buf, w.starts, w.ends, lower=True)
    grams, ptr = ta.windows(h, w.ptr, width)
    n = np.diff(w.ptr)
    for i in range(len(n)):
        if n[i] >= width:
            g = np.sort(grams[ptr[i]:ptr[i + 1]])
            yield g[np.append(True, g[1:] != g[:-1])]
        elif n[i]:
            yield ta.run_hashes(h[w.ptr[i]:w.ptr[i + 1]], np.array([0]), np.array([n[i]]))
        else:
            yield h[:0]


def _class(g: np.ndarray) -> bytes:
    """128-bit name of a set."""
    with np.errstate(over="ignore"):
        return np.array([ta.mix64(g).sum(dtype=_U), ta.mix64(g ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U) + _U(len(g))], dtype=">u8").tobytes()


def _bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return (g >> _U(20)).astype(np.int64) & (buckets - 1)


def needed_overlap(a, b, percent: int):
    """Smallest overlap of sets of sizes a and b with 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def described(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n (set size), cls (name of the set, null if empty) and parts (sizes by hash part)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("parts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in ta.slices(b.column(1)):
                n, cls, parts = [], [], []
                for g in _sets(s, width):
                    n.append(len(g))
                    cls.append(_class(g) if len(g) else None)
                    parts.append(np.minimum(np.bincount((g & _U(PARTS - 1)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s.first, len(n)), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(parts, pa.binary())], names=schema.names)

    return rows.mapInArrow(released(run), schema)


def frequencies(docs: DataFrame, width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Hashed counts of the shingles of all documents, in steps of 1 / STEPS octave (uint8).

    Tasks send one table each, saturating at 255; tables are summed in two levels and
    the driver gets the result alone, ``buckets`` bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(buckets, dtype=np.uint32), False
        for b in batches:
            for s in ta.slices(b.column(0)):
                for g in _sets(s, width):
                    total[_bucket(g, buckets)] += 1
                    some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 255).astype(np.uint8).tobytes()], pa.binary())], names=["t"])

    def add(kind, done):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(buckets, dtype=np.uint32)
            for b in batches:
                for t in b.column(0):
                    total += np.frombuffer(t.as_buffer(), dtype=kind)
            yield pa.RecordBatch.from_arrays([pa.array([done(total).tobytes()], pa.binary())], names=["t"])

        return run

    def coded(total: np.ndarray) -> np.ndarray:
        return np.minimum(np.rint(STEPS * np.log2(1.0 + total)), 255).astype(np.uint8)

    tables = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(count), "t binary")
              .repartition(8).mapInArrow(released(add(np.uint8, lambda x: x)), "t binary")
              .repartition(1).mapInArrow(released(add(np.uint32, coded)), "t binary"))
    return np.frombuffer(tables.head()["t"], dtype=np.uint8)


def shared_prefixes(docs: DataFrame, table: np.ndarray, width: int, percent: int) -> DataFrame:
    """(token, cls, n, pos) of prefix shingles that occur in more than one class, or may."""
    counts = docs.sparkSession.sparkContext.broadcast(table)  # BUCKETS counters
    rows = docs.select(F.col("text").cast("string").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, sent = counts.value, set()
        for b in batches:
            for s in ta.slices(b.column(0)):
                cols: list[list] = [[], [], [], [], []]
                for g in _sets(s, width):
                    if not len(g):
                        continue
                    cls = _class(g)
                    if cls in sent:  # a copy: its class has been sent by this task
                        continue
                    if len(sent) >= SEEN:
                        sent.clear()
                    sent.add(cls)
                    f = freq[_bucket(g, len(freq))]
                    k = prefix_length(len(g), percent)
                    rank = (f.astype(_U) << _U(48)) | (g >> _U(16))
                    head = np.argsort(rank, kind="stable")[:k]
                    token = g[head]
                    salts = np.exp2(f[head] / STEPS).astype(np.int64) // HOT + 1
                    cols[0].append(token)
                    cols[1] += [cls] * len(token)
                    cols[2].append(np.full(len(token), len(g), dtype=np.int32))
                    cols[3].append(np.arange(len(token), dtype=np.int32))
                    cols[4].append((np.where(salts > 1, 1 + int.from_bytes(cls[:4], "big") % salts, 0)).astype(np.int32))
                if cols[1]:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ta.as_int64(np.concatenate(cols[0]))), pa.array(cols[1], pa.binary()),
                        *(pa.array(np.concatenate(c)) for c in cols[2:])], names=["token", "cls", "n", "pos", "salt"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (rows.mapInArrow(released(emit), "token long, cls binary, n int, pos int, salt int").repartition(n, "token", "salt")
             .groupBy("token", "salt", "cls").agg(F.first("n").alias("n"), F.first("pos").alias("pos")))
    among = F.count("*").over(Window.partitionBy("token", "salt"))
    return dealt.withColumn("among", among).where("among > 1 or salt > 0").select("token", "cls", "n", "pos")


def classes(described_docs: DataFrame) -> DataFrame:
    """One row for each distinct set: cls, n, parts, copies and the smallest id."""
    return described_docs.where("cls is not null").groupBy("cls").agg(
        F.first("n").alias("n"), F.first("parts").alias("parts"), F.count("*").alias("copies"), F.min("doc_id").alias("low_id"))


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of class names whose sets are similar; each compared once, exactly.

    Sets are made again from the texts, for the classes of the pairs and a few more: a
    bitmap of FILTER_BITS bits, small at any size of the corpus, tells tasks which.
    """
    spark = docs.sparkSession
    ends = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    bit = F.pmod(F.conv(F.hex(F.substring("cls", 1, 7)), 16, 10).cast("long"), F.lit(FILTER_BITS))
    marked = (ends.select(bit.alias("bit")).selectExpr("bit div 64 AS w", "shiftleft(1L, CAST(bit % 64 AS INT)) AS v")
              .groupBy("w").agg(F.bit_or("v").alias("v")))  # FILTER_BITS / 64 rows at most
    bits = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    found = marked.toPandas()
    bits[found["w"].to_numpy(dtype=np.int64)] = found["v"].to_numpy(dtype=np.int64)
    wanted = spark.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, sent = wanted.value, set()
        for b in batches:
            for s in ta.slices(b.column(0)):
                cls, sets = [], []
                for g in _sets(s, width):
                    name = _class(g) if len(g) else None
                    if name is None or name in sent:
                        continue
                    at = int.from_bytes(name[:7], "big") % FILTER_BITS
                    if not int(flags[at >> 6]) >> (at & 63) & 1:
                        continue
                    if len(sent) >= SEEN:
                        sent.clear()
                    sent.add(name)
                    cls.append(name)
                    sets.append(g)
                if cls:
                    at = np.concatenate([[0], np.cumsum([len(g) for g in sets])]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(cls, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(ta.as_int64(np.concatenate(sets))))], names=["cls", "set"])

    sets = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(emit), "cls binary, set array<long>")
    sets = sets.join(ends.distinct(), "cls", "left_semi").groupBy("cls").agg(F.first("set").alias("set"))
    both = (pairs.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("set_a")), "a")
            .join(sets.select(F.col("cls").alias("b"), F.col("set").alias("set_b")), "b"))

    overlap = F.size(F.array_intersect("set_a", "set_b"))
    return (both.select("a", "b", (F.size("set_a") + F.size("set_b")).alias("total"), overlap.alias("overlap"))
            .where(100 * F.col("overlap") >= percent * (F.col("total") - F.col("overlap"))).select("a", "b"))


def _likely(length: str = "n", other: str = "pn", percent: int = PERCENT):
    """Length filter."""
    return (100 * F.least(length, other) >= percent * F.greatest(length, other))


def _overlap_left(percent: int):
    """Positional filter: what may still overlap, from the shared shingle on, suffices."""
    need = F.ceil(percent * (F.col("n") + F.col("pn")) / F.lit(100 + percent))
    return F.least(F.col("n") - F.col("pos"), F.col("pn") - F.col("ppos")) >= need


def star_pairs(shared: DataFrame, percent: int) -> DataFrame:
    """Every class with the pivot of each of its prefix shingles: the class of most copies."""
    pivot = shared.groupBy("token").agg(F.max(F.struct("copies", "cls", "n", "pos")).alias("p"))
    near = (shared.join(pivot, "token").select("cls", "n", "pos", F.col("p.cls").alias("pcls"), F.col("p.n").alias("pn"), F.col("p.pos").alias("ppos"))
            .where((F.col("cls") != F.col("pcls")) & _likely(percent=percent) & _overlap_left(percent)))
    return near.select(F.least("cls", "pcls").alias("a"), F.greatest("cls", "pcls").alias("b")).distinct()


def _length_class(n, percent: int):
    # The small addend keeps powers of the ratio on their own side of the floor.
    return F.floor(F.log(n.cast("double")) / F.lit(float(np.log(100 / percent))) + F.lit(1e-9)).cast("int")


def cross_pairs(shared: DataFrame, parts: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Candidate pairs of different components (column ``comp``), compared in blocks.

    Rows of a (shingle, length class) group are parted into those of its largest
    component and the rest, both in blocks by hash; the largest component's blocks meet
    only the rest's, the rest's blocks also each other.  Similar sizes fall into the
    same length class or neighbours, so each row also visits the next class.
    """
    placed = (shared.withColumn("home", _length_class(F.col("n"), percent))
              .withColumn("lc", F.explode(F.array(F.col("home"), F.col("home") + 1))))
    sizes = placed.groupBy("token", "lc", "comp").agg(F.count("*").alias("m"), F.max(F.col("home") == F.col("lc")).alias("h"))
    groups = (sizes.groupBy("token", "lc").agg(F.max(F.struct("m", "comp")).alias("d"), F.sum("m").alias("m"), F.count("*").alias("comps"), F.max("h").alias("h"))
              .where("comps > 1 and h").select("token", "lc", F.col("d.comp").alias("dom"),
                                         F.ceil(F.col("d.m") / block).cast("int").alias("dn"),
                                         F.ceil((F.col("m") - F.col("d.m")) / block).cast("int").alias("rn")))
    rows = placed.join(groups, ["token", "lc"])
    of_dom = F.col("comp") == F.col("dom")
    own = F.when(of_dom, F.pmod(F.xxhash64("cls"), F.col("dn"))).otherwise(F.col("dn") + F.pmod(F.xxhash64("cls"), F.col("rn"))).cast("int")
    rest = F.sequence(F.col("dn"), F.col("dn") + F.col("rn") - 1)
    meets = F.when(of_dom, rest).otherwise(F.concat(F.sequence(F.lit(0), F.col("dn") - 1), rest))
    rows = (rows.withColumn("own", own).withColumn("meets", F.explode(meets))
            .select("token", "lc", F.least("own", "meets").alias("x"), F.greatest("own", "meets").alias("y"), "own",
                    (F.col("home") == F.col("lc")).alias("at_home"), "cls", "comp", F.col("n").cast("int").alias("n"), "pos")
            .join(parts, "cls"))
    n = int(shared.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "token", "lc", "x", "y").sortWithinPartitions("token", "lc", "x", "y")

    def pairs_of(g: pa.Table) -> tuple[list[bytes], list[bytes]]:
        cls = g.column("cls").to_pylist()
        _, comp = np.unique(np.array(g.column("comp").to_pylist(), dtype=object), return_inverse=True)
        own, home = g.column("own").to_numpy(), g.column("at_home").to_numpy(zero_copy_only=False)
        size, pos = g.column("n").to_numpy().astype(np.int64), g.column("pos").to_numpy().astype(np.int64)
        parts = np.frombuffer(b"".join(g.column("parts").to_pylist()), dtype=np.uint8).reshape(len(cls), -1).astype(np.int16)
        a, b = [], []
        x, y = g.column("x")[0].as_py(), g.column("y")[0].as_py()
        left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
        for i in left:
            k = right[right > i] if x == y else right
            k = k[(comp[k] != comp[i]) & (home[k] | home[i])]
            k = k[100 * np.minimum(size[k], size[i]) >= percent * np.maximum(size[k], size[i])]
            need = needed_overlap(size[k], size[i], percent)
            fits = np.minimum(size[k] - pos[k], size[i] - pos[i]) >= need
            k, need = k[fits], need[fits]
            if len(k):
                apart = np.abs(parts[k] - parts[i]).sum(1)
                for j in k[(size[k] + size[i] - apart) // 2 >= need]:
                    u, v = cls[i], cls[j]
                    a.append(min(u, v))
                    b.append(max(u, v))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            if not t.num_rows:
                continue
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("token", "lc", "x", "y")])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            edges = [0, *cuts.tolist()]
            rest = t.slice(edges[-1])
            yield from found([t.slice(p, q - p) for p, q in zip(edges, edges[1:])])
        if rest is not None:
            yield from found([rest])

    def found(groups: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in groups:
            if g.num_rows > 1:
                p, q = pairs_of(g)
                a += p
                b += q
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return rows.mapInArrow(released(run), "a binary, b binary").distinct()


def labelled(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with the component ``comp`` of their class (its own name without links)."""
    return nodes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("comp", F.coalesce("root", "cls")).drop("root")


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_shingles, component_id and cls of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ship(spark)
    rows = checkpointed(described(docs, width))
    named = classes(rows)
    shared = shared_prefixes(docs, frequencies(docs, width, buckets), width, percent)
    shared = checkpointed(shared.join(named.select("cls", "copies"), "cls"))
    links = checkpointed(verified(docs, star_pairs(shared, percent), width, percent))
    first = connected_components(links)
    pairs = checkpointed(cross_pairs(labelled(shared.drop("copies"), first), named.select("cls", "parts"), percent))
    more = verified(docs, pairs, width, percent)
    roots = connected_components(links.union(more))
    comps = labelled(named.select("cls", "low_id"), roots)
    lowest = comps.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    of_class = comps.join(lowest, "comp").select("cls", "component_id")
    return rows.join(of_class, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return join(docs).select("doc_id", "n_shingles", "component_id")


def tagged(docs: DataFrame, width: int) -> DataFrame:
    """All columns of ``docs`` as ``_0``, ``_1``, ... with ``_cls``, the name of the row's set."""
    rows = docs.select(F.col("text").cast("string").alias("_text"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_cls", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls = [_class(g) if len(g) else None for s in ta.slices(b.column(0)) for g in _sets(s, width)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(cls, pa.binary())], names=schema.names)

    return rows.mapInArrow(released(run), schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: the one of smallest id, once if rows repeat.

    Documents without words, which link with nothing, all stay; of a component without
    any id, every row stays.
    """
    found = join(docs.select("doc_id", "text"), width=STAGE_WIDTH, percent=STAGE_PERCENT).where("cls is not null")
    gone = found.where("component_id is not null and not (doc_id <=> component_id)").select(
        F.col("doc_id").alias("_gone_id"), F.col("cls").alias("_gone_cls")).distinct()
    rows = tagged(docs, STAGE_WIDTH)
    me = f"_{docs.columns.index('doc_id')}"
    kept = rows.join(gone, (F.col("_cls") == F.col("_gone_cls")) & F.col(me).eqNullSafe(F.col("_gone_id")), "left_anti")
    repeats = found.where("doc_id is not null").groupBy("doc_id", "cls").count().where("count > 1")
    if repeats.head(1):
        once = Window.partitionBy(me, "_cls").orderBy(f"_{docs.columns.index('text')}")
        kept = kept.withColumn("_nth", F.row_number().over(once)).where(F.col("_cls").isNull() | F.col(me).isNull() | (F.col("_nth") == 1))
    return kept.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])
