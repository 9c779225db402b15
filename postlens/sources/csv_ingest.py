"""CSV source and sink for post archives.

Any number of files of any layout: encoding, header and column roles are decided for each
file by itself.  Reading is splittable, also with line breaks inside quotes.

Files are read as lines (``spark.read.text``).  A line with an even number of quotes leaves
the state "inside quotes" as it was, one with an odd number changes it, so only odd lines
matter: a first pass returns one row for each split (lines, odd lines, invalid UTF-8), a
prefix sum over splits gives the state and the line number at the start of each, and in
the order of a file its odd lines alternately open and close a *span*, a record of several
lines.  All other lines are records as they stand and are never shuffled; without spans
there is no exchange of lines at all.  The line numbers of spans are broadcast while there
are up to ``SPAN_LINES``; beyond, the task that reads a split joins the lines of its spans,
and only the pieces of those that cross a split's border, one for each split, are shuffled.
(Quotes must be balanced, as CSV writers leave them.)

Decisions for each file:

* encoding, over the whole file.  UTF-8 if every line is valid UTF-8; else the Japanese
  encoding (windows-31j, Shift_JIS, EUC-JP) that decodes most lines without replacement,
  of equals the one with most full-width Japanese characters; UTF-8 with replacement
  characters if each of them spoils more lines.
* column roles, from the first ``GUESS_SAMPLE_ROWS`` records (content, not names), see
  ``ROLES``.  Ties pick the leftmost column.  A header that already names the canonical
  columns is used as is.
* header: the first record is a header when its created_at cell does not parse.

What is kept of a file is one row for it or for each of its splits; these are what is
broadcast.  No setting of the session is changed for longer than an expression is built.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..session import materialize

CANONICAL = ["tweet_id", "created_at", "text", "status_url"]
# Lines of each file that its first records are first looked for in; 16 times as many next.
HEAD_LINES = 4096
# Most lines of records of several lines whose numbers (8 bytes and the span's) are broadcast.
SPAN_LINES = 1 << 20
# A line's key: the file's number above this many bits, its own number below.
_LINE_BITS = 40
ENCODINGS = ["UTF-8", "windows-31j", "Shift_JIS", "EUC-JP"]

_DATE_PARSE = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?: ([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?$"
_DATE_PARSE_T = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?)?$"


class CSVLoadError(Exception):
    pass


@dataclass(frozen=True)
class ColumnMapping:
    tweet_id: str
    created_at: str
    text: str
    status_url: str | None = None


def parse_created_at(col: Column, accept_t: bool = False) -> Column:
    """'YYYY-MM-DD HH:MM:SS', 'YYYY-MM-DD HH:MM' or 'YYYY-MM-DD' (after trimming)
    to TIMESTAMP_NTZ; anything else (or an impossible date) to null.  Independent
    of the session time zone.  ``accept_t`` also takes 'T' between date and time
    (the column guess counts such cells as dates, the original parser did not)."""
    s = F.trim(col.cast("string"))
    pattern = _DATE_PARSE_T if accept_t else _DATE_PARSE
    ok = s.rlike(pattern)

    def part(i: int, default: int = 0) -> Column:
        v = F.regexp_extract(s, pattern, i)
        return F.when(v == "", F.lit(default)).otherwise(v.cast("int"))

    ts = F.try_make_timestamp_ntz(part(1), part(2), part(3), part(4), part(5), part(6).cast("decimal(16,6)"))
    # make_timestamp_ntz turns second 60 into the next minute; a clock reading of :60 is not accepted here
    return F.when(ok & (part(6) < 60), ts)


_CSV_OPTIONS = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
_LEGACY = {"spark.sql.legacy.javaCharsets": "true", "spark.sql.legacy.codingErrorAction": "true"}


@contextmanager
def _legacy_charsets(spark: SparkSession):
    """``decode`` takes these settings when it is analysed; they are put back at once."""
    before = {k: spark.conf.get(k, None) for k in _LEGACY}
    try:
        for k, v in _LEGACY.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, at, value): raw lines; ``at`` ascends within a split, ``block`` is its start."""
    return (spark.read.option("lineSep", "\n").text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("at"), "value"))


def _decoded(lines: DataFrame, encoding: str, column: str = "value") -> DataFrame:
    """``lines`` with ``column`` as valid text; bytes that are none become U+FFFD."""
    if encoding == "UTF-8":
        return lines.withColumn(column, F.make_valid_utf8(column))
    with _legacy_charsets(lines.sparkSession):
        return lines.withColumn(column, F.decode(F.col(column).cast("binary"), encoding))


def _japanese_scores(lines: DataFrame, by: list[str]) -> DataFrame:
    """Per group and encoding: lines with replacement characters, full-width less half-width Japanese."""
    rows = lines
    for k, enc in enumerate(ENCODINGS[1:]):
        rows = _decoded(rows.withColumn(f"t{k}", F.col("value")), enc, f"t{k}")
    return rows.groupBy(*by).agg(F.count_if(~F.is_valid_utf8("value")).alias("spoilt"), *[a for k in range(len(ENCODINGS) - 1) for a in (
        F.count_if(F.col(f"t{k}").contains("\ufffd")).alias(f"bad{k}"),
        F.sum(F.regexp_count(f"t{k}", F.lit(r"[\p{IsHiragana}\p{IsHan}\x{30A0}-\x{30FF}]"))
              - F.regexp_count(f"t{k}", F.lit(r"[\x{FF61}-\x{FF9F}]"))).alias(f"ja{k}"))])


def _best_encoding(scores: DataFrame) -> Column:
    """Number in ENCODINGS: fewest spoilt lines, then most Japanese, then the first."""
    each = [F.struct(F.col(f"bad{k}").alias("bad"), (-F.col(f"ja{k}")).alias("ja"), F.lit(k + 1).alias("k")) for k in range(len(ENCODINGS) - 1)]
    best = F.least(*each)
    return F.when(best["bad"] <= F.col("spoilt"), best["k"]).otherwise(0)


def detect_encoding(spark: SparkSession, path) -> str:
    """Encoding of the whole input: one pass, or two if it is not UTF-8."""
    lines = spark.read.option("lineSep", "\n").text(path)
    if not lines.agg(F.count_if(~F.is_valid_utf8("value")).alias("n")).head()["n"]:
        return "UTF-8"
    scores = _japanese_scores(lines, [])
    return ENCODINGS[scores.select(_best_encoding(scores).alias("k")).head()["k"]]


def _is_odd(value: str) -> Column:
    return (F.octet_length(value) - F.octet_length(F.replace(F.col(value), F.lit('"'), F.lit("")))) % 2 == 1


def _splits(lines: DataFrame) -> DataFrame:
    """One row for each split: least ``at``, lines, lines that are not UTF-8, and the odd lines."""
    return lines.groupBy("file", "block").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.count_if(~F.is_valid_utf8("value")).alias("bad"),
        F.array_sort(F.collect_list(F.when(_is_odd("value"), F.col("at")))).alias("odd"))


def _joined(lines: DataFrame) -> DataFrame:
    """(f, key, value): records of ``lines`` (f, key, value, odd), by the key of their first line.
    A task has the lines of its splits in their order, and no span crosses a split's border."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []  # of the span that the last batch has left open, and its lines
        for b in batches:
            if not b.num_rows:
                continue
            f, keys, values, odd = b.columns
            after = np.cumsum(odd.to_numpy(zero_copy_only=False)) + (key is not None)  # odd: a span is open behind the line
            begins = np.flatnonzero(np.append(key is None, after[:-1] % 2 == 0))
            head = int(begins[0]) if len(begins) else b.num_rows
            out = []
            held += values.slice(0, head).to_pylist()
            if head and (len(begins) or after[-1] % 2 == 0):
                out.append([f.slice(0, 1), pa.array([key], pa.int64()), pa.array(["\n".join(held)], pa.string())])
                key, held = None, []
            ends = np.append(begins, b.num_rows)
            if len(begins) and after[-1] % 2 == 1:
                key, held = keys[int(begins[-1])].as_py(), values.slice(int(begins[-1])).to_pylist()
                begins, ends = begins[:-1], ends[:-1]
            if len(begins):
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)
                out.append([f.take(pa.array(begins)), keys.take(pa.array(begins)), pc.binary_join(lists, "\n")])
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out)], names=["f", "key", "value"])

    return lines.select("f", "key", "value", "odd").mapInArrow(run, "f long, key long, value string")


def _line_of(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << _LINE_BITS) - 1))


class Source:
    """Lines of the input, surveyed once.

    ``table`` has a row for each split, as the driver's own list of splits has: its file's
    number ``f``, ``base`` (a line's key less its ``at``), its ``start`` key, the file's ``last``
    key, how many odd lines the file has before it, the number of its encoding, and whether it is dirty,
    that is touches a span.  ``opened`` is the key of the line that opened the span the split
    begins in, which has its lines up to the key ``until``; from the key ``since`` on a span
    goes on behind the split.
    """

    def __init__(self, spark: SparkSession, path, encoding: str | None = None) -> None:
        self.lines = _lines(spark, path)
        self.encodings = [encoding] if encoding is not None else ENCODINGS
        self._splits = materialize(_splits(self.lines))
        # step: the last odd line less the one before, plus the one before that ...
        found = sorted(self._splits.select("file", "block", "first", "n", "bad", F.size("odd").alias("odd"), F.array_min("odd").alias("turn"), F.array_max("odd").alias("turned"),
                                           F.aggregate("odd", F.lit(0).cast("long"), lambda t, x: x - t).alias("step")).collect())
        files: dict[str, list] = {}
        for r in found:
            files.setdefault(r["file"], []).append(r)
        spoilt = [f for f, rows in files.items() if any(r["bad"] for r in rows)] if encoding is None else []
        code = dict.fromkeys(files, 0)
        if spoilt:
            some = spark.createDataFrame([(f,) for f in spoilt], "file string")
            scores = _japanese_scores(self.lines.join(F.broadcast(some), "file"), ["file"])
            code |= {r["file"]: r["enc"] for r in scores.select("file", _best_encoding(scores).alias("enc")).collect()}
        table, self.span_lines = [], 0
        for k, (file, rows) in enumerate(files.items()):
            start, line, odd, opened = k << _LINE_BITS, 0, 0, None
            last = start + sum(r["n"] for r in rows) - 1
            for r in rows:
                begin = start + line
                base = begin - r["first"]
                until = None if opened is None else base + r["turn"] if r["odd"] else begin + r["n"] - 1
                line, before, odd = line + r["n"], odd, odd + r["odd"]
                since = base + r["turned"] if r["odd"] and odd % 2 else None
                table.append((file, r["block"], k, base, begin, last, before, opened, until, since, code[file], bool(r["odd"] or before % 2)))
                step = r["step"]
                if before % 2:  # spans run from the first of two turns to the second: the split's ends count where they cut one
                    step += r["first"] * (-1) ** r["odd"]
                if odd % 2:
                    step = r["first"] + r["n"] - 1 - step
                self.span_lines += step + (r["odd"] + before % 2 + odd % 2) // 2
                opened = (since if r["odd"] else opened) if odd % 2 else None
        self.present = sorted(set(code.values()))
        self.lengths = [sum(r["n"] for r in rows) for rows in files.values()]
        self.table = spark.createDataFrame(table, "file string, block long, f long, base long, start long, last long, earlier long, opened long, until long, since long, enc int, dirty boolean")

    def spans(self) -> DataFrame:
        """(f, open, key): the lines of records of several lines; ``open`` is the first line's key."""
        odd = (self._splits.where(F.size("odd") > 0).join(F.broadcast(self.table), ["file", "block"])
               .select("f", "base", "last", "earlier", F.posexplode("odd").alias("k", "at")))
        pairs = (odd.groupBy("f", F.floor((F.col("earlier") + F.col("k")) / 2).alias("pair"))
                 .agg(F.min(F.col("at") + F.col("base")).alias("open"), F.max(F.col("at") + F.col("base")).alias("end"),
                      F.count(F.lit(1)).alias("n"), F.max("last").alias("last")))
        close = F.when(F.col("n") == 2, F.col("end")).otherwise(F.col("last"))  # never closed: to the end of the file
        return pairs.select("f", "open", F.explode(F.sequence("open", close)).alias("key"))

    def numbered(self) -> DataFrame:
        """(f, key, value, dirty, odd, border, start): decoded lines; dirty where the split touches a
        span, odd in raw bytes, border the first line's key of a span that crosses the split's border
        and start the split's first key."""
        rows = self.lines.join(F.broadcast(self.table), ["file", "block"]).withColumn("raw", F.col("value"))
        text = F.lit(None)
        for k in self.present:
            rows = _decoded(rows.withColumn(f"t{k}", F.when(F.col("enc") == k, F.col("raw"))), self.encodings[k], f"t{k}")
            text = F.coalesce(text, F.col(f"t{k}"))
        key = F.col("at") + F.col("base")
        border = F.when(key <= F.col("until"), F.col("opened")).when(key >= F.col("since"), F.col("since"))
        return rows.select("f", key.alias("key"), text.alias("value"), "dirty",
                           _is_odd("raw").alias("odd"), border.alias("border"), "start")

    def records(self, first_lines: int | None = None) -> DataFrame:
        """(f, key, record): records that are not empty, by the key of their first line; with
        ``first_lines`` those that begin in that many lines of their file."""
        rows = self.numbered()

        def wanted(lines: DataFrame, key: str) -> DataFrame:
            return lines if first_lines is None else lines.where(_line_of(F.col(key)) < first_lines)

        if not self.span_lines:
            parts = [wanted(rows, "key")]
        elif self.span_lines <= SPAN_LINES:
            spans = F.broadcast(wanted(self.spans(), "open"))
            inside = rows.where("dirty").select("key", "value").join(spans, "key")
            parts = [wanted(rows, "key").join(spans.select("key"), "key", "left_anti"), self._gathered(inside, "open")]
        else:
            # The first lines of a file are those of its first splits; the whole of each is joined.
            own = rows.where("dirty AND border IS NULL")
            if first_lines is not None:
                own = own.where(_line_of(F.col("start")) < first_lines)
            parts = [wanted(rows.where("not dirty"), "key"), wanted(_joined(own), "key"),
                     self._gathered(wanted(rows.where("border IS NOT NULL"), "border"), "border")]
        out = reduce(DataFrame.union, [p.select("f", "key", F.regexp_replace("value", "\r$", "").alias("record")) for p in parts])
        return out.where("record != ''")

    @staticmethod
    def _gathered(lines: DataFrame, by: str) -> DataFrame:
        return (lines.groupBy("f", F.col(by).alias("first")).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("p"))
                .select("f", F.col("first").alias("key"), F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value")))

    def heads(self) -> tuple[DataFrame, int | None]:
        """(f, head, width): the first GUESS_SAMPLE_ROWS + 1 records of each file that has any, in
        order, and the columns of its first; and the most columns of any file."""
        want, lines = P.GUESS_SAMPLE_ROWS + 1, HEAD_LINES
        width = F.regexp_count(F.regexp_replace(F.col("head")[0]["record"], '"[^"]*"', ""), F.lit(",")) + 1
        while True:
            found = materialize(self.records(lines).groupBy("f").agg(F.array_sort(F.collect_list(F.struct("key", "record"))).alias("head"))
                                .select("f", F.slice("head", 1, want).alias("head")).withColumn("width", width))
            full = found.agg(F.count_if(F.size("head") >= want).alias("n"), F.max("width").alias("most")).head()
            longer = sum(n > lines for n in self.lengths)
            if longer <= full["n"] or not found.join(self.table.where(_line_of(F.col("last")) >= lines).select("f").distinct(), "f", "right").where(
                    F.col("head").isNull() | (F.size("head") < want)).count():
                return found, full["most"]
            found.unpersist()
            lines *= 16


def _cells(record: Column, width: int) -> Column:
    row = F.from_csv(record, F.lit(", ".join(f"c{k} string" for k in range(width))), _CSV_OPTIONS)
    return F.array(*[row[f"c{k}"] for k in range(width)])


#: Column roles in the order they are given: role, score of a column, whether only among
#: columns that no role has yet (all if none is left).  The best score wins.
ROLES = [("created_at", "dates", False), ("status_url", "links", False), ("text", "length", True), ("tweet_id", "ids", True)]


def _scores(rows: DataFrame, sample: Column) -> list[Column]:
    v = F.when(sample, F.col("v"))
    return [F.count_if(v.rlike(P.DATE_GUESS_PATTERN)).cast("double").alias("dates"), F.count_if(F.lower(v).contains("http")).cast("double").alias("links"),
            F.coalesce(F.avg(F.char_length(v)), F.lit(0.0)).alias("length"),
            F.count_if(v.rlike(r"^\p{Nd}+$") & (F.char_length(v) >= 10)).cast("double").alias("ids")]


def _with_roles(files: DataFrame, columns: str, prefix: str) -> DataFrame:
    """``files`` with the column number of each role; status_url null if no cell has a link."""
    taken: list[Column] = []
    for role, score, only_free in ROLES:
        every = F.col(columns)
        free = reduce(lambda c, t: F.filter(c, lambda x: ~x["c"].eqNullSafe(t)), taken, every) if only_free else every
        among = F.when(F.size(free) > 0, free).otherwise(every)
        best = F.array_max(F.transform(among, lambda x: F.struct(x["s"][score].alias("s"), (-x["c"]).alias("left"))))
        number = -best["left"]
        if role == "status_url":
            number = F.when(best["s"] > 0, number)
        files = files.withColumn(prefix + role, number)
        taken.append(F.col(prefix + role))
    return files


def _layouts(source: Source, has_header: bool | None, accept_t: bool) -> tuple[DataFrame, int]:
    """One row for each file with records: its roles' column numbers and ``skip``, the key of
    its header; and the most columns of any file."""
    heads, most = source.heads()
    if most is None:
        raise CSVLoadError("CSV was read but contains no rows")
    rows = (heads.select("f", "width", F.posexplode("head").alias("rn", "r"))
            .select("f", "width", "rn", F.posexplode(_cells(F.col("r.record"), most)).alias("c", "v")).where("c < width"))
    n = P.GUESS_SAMPLE_ROWS
    scored = (rows.groupBy("f", "c").agg(F.struct(*_scores(rows, F.col("rn") < n)).alias("bare"),
                                         F.struct(*_scores(rows, F.col("rn") > 0)).alias("titled"),
                                         F.max(F.when(F.col("rn") == 0, F.col("v"))).alias("name"))
              .groupBy("f").agg(F.array_sort(F.collect_list(F.struct("c", F.col("bare").alias("s"), "name"))).alias("bare"),
                                F.array_sort(F.collect_list(F.struct("c", F.col("titled").alias("s")))).alias("titled")))
    found = _with_roles(_with_roles(scored, "bare", "bare_"), "titled", "titled_")
    names = F.transform("bare", lambda x: F.coalesce(x["name"], F.lit("")))
    header = F.lit(has_header) if has_header is not None else parse_created_at(F.get(names, F.col("bare_created_at")), accept_t).isNull()
    found = found.withColumn("names", names).withColumn("header", header)
    named = reduce(lambda a, c: a & F.array_contains("names", c), CANONICAL[:3], F.col("header"))
    roles = [F.when(named, F.nullif(F.array_position("names", F.lit(c)).cast("int"), F.lit(0)) - 1)
             .when(F.col("header"), F.col(f"titled_{c}")).otherwise(F.col(f"bare_{c}")).alias(f"at_{c}") for c in CANONICAL]
    keyed = found.join(heads.select("f", F.col("head")[0]["key"].alias("begin")), "f")
    return keyed.select("f", *roles, F.when(F.col("header"), F.col("begin")).alias("skip")), most


def normalize_posts(df: DataFrame, mapping: ColumnMapping, accept_t: bool = False) -> DataFrame:
    """Project the four canonical columns as strings (status_url null when
    absent) and parse created_at."""
    def c(name):
        return F.col(f"`{name}`").cast("string")
    status = c(mapping.status_url) if mapping.status_url else F.lit(None).cast("string")
    return df.select(c(mapping.tweet_id).alias("tweet_id"),
                     parse_created_at(c(mapping.created_at), accept_t).alias("created_at"),
                     c(mapping.text).alias("text"), status.alias("status_url"))


def parse_score(df: DataFrame) -> DataFrame:
    """Number of rows whose created_at parsed."""
    if "created_at" not in df.columns:
        return df.sparkSession.createDataFrame([(0,)], "parsed bigint")
    return df.agg(F.count("created_at").alias("parsed"))


def read_posts_csv(spark: SparkSession, path, has_header: bool | None = None,
                   encoding: str | None = None, accept_t: bool = False) -> DataFrame:
    """Posts from CSV file(s), each of its own layout: tweet_id, created_at (TIMESTAMP_NTZ), text, status_url."""
    source = Source(spark, path, encoding)
    layouts, most = _layouts(source, has_header, accept_t)
    rows = source.records().join(F.broadcast(layouts), "f").where("skip IS NULL OR key != skip")  # a row for each file
    rows = rows.withColumn("cells", _cells(F.col("record"), most))
    rows = rows.select(*[F.get("cells", F.col(f"at_{c}")).alias(c) for c in CANONICAL])
    return normalize_posts(rows, ColumnMapping(*CANONICAL), accept_t)


def write_csv(df: DataFrame, path: str) -> str:
    """Result table -> CSV with header (UTF-8).  Arrays and structs are written as
    JSON text.  An empty result is an error, as in the original export."""
    if df.isEmpty():
        raise CSVLoadError("nothing to export")
    cols = []
    for f in df.schema.fields:
        simple = f.dataType.simpleString()
        if simple.startswith(("array", "struct", "map")):
            cols.append(F.to_json(F.col(f"`{f.name}`")).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    (df.select(*cols).write.mode("error").option("header", True).option("encoding", "UTF-8")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("quoteAll", False).option("escape", '"').csv(path))
    return path
