"""Main text of web pages from streaming parser events and text-to-tag ratios.

The standard library's parser feeds events to :class:`Blocks`, which cuts the page
into block lines (the text between block-level tags) and counts the tags of each.
The text-to-tag ratio of every line is smoothed with a Gaussian and thresholded at
the spread of the page; lines above it seed the content region.  The region is all
article and main elements that hold seeds, if most of the seeds' text is in them, or
else the lowest division that holds all seeds.  All of its lines belong to the result,
short paragraphs and lists of links too, but for those inside elements that by tag,
role or class are menus, headers, footers, sidebars, notices, adverts, forms or comments.

Marks are believed of parts of a page only: where nothing else is left, the marked elements
that hold most of the seeds' text, the outermost first, count as unmarked (a page that is
one form, or whose content division is named after its sidebar).

Declarations and marked sections of any kind are skipped to the next ``>``, as browsers do;
text or another element ends a head that was never closed.

Defined results: null or empty html and pages without text give an empty string;
unclosed and stray tags are tolerated; repeated rows give repeated results; an empty
table gives no rows; other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import released, ship

SIGMA = 1.0          # of the Gaussian, in lines

HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
DIVISIONS = frozenset("page html body div center dialog".split())  # what can be a region without article or main

# HTML element names and the usual words in classes, ids and roles.
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p
pre search section summary table tbody td tfoot th thead tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("""head title script style noscript template svg math iframe object canvas audio video select
textarea button datalist""".split())
ASIDE = frozenset("nav header footer aside form menu dialog search".split())
ROLES = frozenset("""navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog
alert status""".split())
WORDS = frozenset("""ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promoted
promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay sidebar sidebars menu menus nav
navbar navigation navigations breadcrumb breadcrumbs footer masthead comment comments reply replies respond disqus share
sharing social related recommended recommendations newsletter subscribe subscription signup login toolbar pagination
pager widget widgets skip""".split())
PLAIN_HEADER = frozenset("header page-header site-header top-header main-header topbar".split())

_COMMENT = frozenset("comment comments comment-body comment-list comment-content".split())

_WHITE = re.compile(r"\s+")
_SPLIT = re.compile(r"[\s_-]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_COMMENT_END = re.compile("--!?>")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _boilerplate(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in ASIDE:
        return True
    for name, value in attrs:
        if name in ("class", "id"):
            names = value or ""
            if names.lower() in PLAIN_HEADER or not WORDS.isdisjoint(_SPLIT.split(_CAMEL.sub("-", names).lower())):
                return tag not in ("body", "html", "article", "main") or not _COMMENT.isdisjoint(names.lower().split())
        elif name == "role" and (value or "").lower() in ROLES:
            return True
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and _HIDDEN.search(value):
            return True
    return False


class Blocks(HTMLParser):
    """Block lines of a page. Nodes are numbered block elements; node 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.kind = [0], ["page"]
        self.open: list[tuple[str, int]] = [("page", 0)]  # open block and silent elements with their node
        self.off = 0              # open silent or boilerplate elements
        self.off_at: list[bool] = [False]
        self.silent = 0
        self.link = 0
        self.text: list[str] = []
        self.link_chars = self.tags = 0
        self.lines: list[tuple[str, int, int, bool, bool]] = []  # text, node, tags, boilerplate, only links
        self.marked: list[bool] = [False]                 # of each node: marked as boilerplate
        self.doubtful: list[bool] = []                    # of each line: off by marks of nodes alone

    def flush(self) -> None:
        if self.text:
            line = _WHITE.sub(" ", "".join(self.text)).strip()
            if line:
                linked = self.link_chars >= sum(len(x) for x in self.text) - 2
                self.lines.append((line, self.open[-1][1], self.tags, self.off > 0, linked))
                self.doubtful.append(self.off == sum(off for (tag, _), off in zip(self.open, self.off_at) if tag in BLOCK) if self.off else False)
                self.tags = 0
            self.text = []
        self.link_chars = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def parse_comment(self, i: int, report: int = 1) -> int:
        end = _COMMENT_END.search(self.rawdata, i + 2)
        return end.end() if end else -1

    def leave_head(self) -> None:
        if self.open[-1][0] == "head":
            self.leave(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self.leave_head()
        self.tags += 1
        if tag == "a":
            self.link += 1
        if tag == "br":
            self.text.append(" ")
        silent = tag in SILENT
        if tag not in BLOCK and not silent:
            if tag not in VOID and attrs and _boilerplate(tag, attrs):
                self.enter(tag, True)  # an inline element that is an advert or the like
            return
        if not silent:
            self.flush()
        if tag in VOID:
            return
        if tag in BLOCK and self.open[-1][0] == "button":
            self.leave(len(self.open) - 1)  # never closed
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and self.open[-1][0] == tag or self.open[-1][0] == "p" and not silent:
            self.leave(len(self.open) - 1)
        if silent:
            self.silent += 1
        self.enter(tag, silent or _boilerplate(tag, attrs))

    def enter(self, tag: str, off: bool) -> None:
        node = self.open[-1][1]
        if tag in BLOCK:
            self.parent.append(node)
            self.kind.append(tag)
            node = len(self.kind) - 1
            self.marked.append(off)
        elif off:
            self.flush()
        self.open.append((tag, node))
        self.off_at.append(off)
        self.off += off

    def leave(self, depth: int) -> None:
        """Close open elements down to ``depth``."""
        self.flush()
        while len(self.open) > max(depth, 1):
            tag, _ = self.open.pop()
            self.off -= self.off_at.pop()
            self.silent -= tag in SILENT

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.link = max(0, self.link - 1)
        if tag in BLOCK and not self.silent:
            self.flush()
        if tag in VOID:
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == tag:
                self.leave(k)
                return
            if tag == "p" and self.open[k][0] != "p":
                return  # a stray </p> closes nothing else

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag in BLOCK or tag in SILENT):
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "head" and not data.isspace():
            self.leave_head()
        if not self.silent:
            self.text.append(data)
            if self.link:
                self.link_chars += len(data)


def ratios(lines: list[tuple[str, int, int, bool, bool]], sigma: float = SIGMA) -> tuple[np.ndarray, float]:
    """Smoothed text-to-tag ratio of every line and the threshold."""
    raw = np.array([len(x[0]) / max(x[2], 1) for x in lines])
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    padded = np.pad(raw, reach)
    weight = np.convolve(np.pad(np.ones(len(raw)), reach), kernel, "valid")
    smooth = np.convolve(padded, kernel, "valid") / weight
    return smooth, float(smooth.std())


def _unmarked(page: Blocks) -> list[bool]:
    """Whether each line is off when the marked nodes that hold most of the page are not believed."""
    n = len(page.kind)
    mass = [0] * n
    for x, doubtful in zip(page.lines, page.doubtful):
        if doubtful:
            mass[x[1]] += len(x[0])
    for node in range(n - 1, 0, -1):
        mass[page.parent[node]] += mass[node]
    off = [False] * n  # nodes come after their parents
    for node in range(1, n):
        off[node] = off[page.parent[node]] or page.marked[node] and 2 * mass[node] <= mass[0]
    return [off[x[1]] or not doubtful for x, doubtful in zip(page.lines, page.doubtful)]


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Blocks()
    page.feed(html)
    page.close()
    page.flush()
    lines = page.lines
    if lines and all(x[3] for x in lines):
        lines = [(*x[:3], off, x[4]) for x, off in zip(lines, _unmarked(page))]
    if not lines:
        return ""
    smooth, threshold = ratios(lines)
    seeds = [not x[3] and s >= threshold for x, s in zip(lines, smooth)]
    if not any(seeds):
        seeds = [not x[3] for x in lines]
    if not any(seeds):
        return ""
    n = len(page.kind)
    mass = [0] * n
    for x, seed in zip(lines, seeds):
        if seed:
            mass[x[1]] += len(x[0])
    for node in range(n - 1, 0, -1):
        mass[page.parent[node]] += mass[node]
    named = [k for k in range(n) if page.kind[k] in ("article", "main") and mass[k]]
    within = [False] * n
    for k in named:
        within[k] = True
    for node in range(1, n):
        within[node] |= within[page.parent[node]]
    if 2 * sum(len(x[0]) for x, seed in zip(lines, seeds) if seed and within[x[1]]) < mass[0] or not named:
        region = max(k for k in range(n) if mass[k] == mass[0])  # nodes are numbered from the outside in
        while page.kind[region] not in DIVISIONS:
            region = page.parent[region]
        within = [k == region for k in range(n)]
        for node in range(region + 1, n):
            within[node] |= within[page.parent[node]]
    return "\n".join(x[0] for x in lines if within[x[1]] and not x[3])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page; no shuffle."""
    ship(pages.sparkSession)
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                texts = [main_text(x.as_py()) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(released(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
