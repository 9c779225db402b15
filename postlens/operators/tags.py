"""Hashtag and mention operators, keyword categories."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import pairs as PR
from .links import top_keys_by_period


def exploded_tags(df: DataFrame, list_col: str, name: str, *keep: str) -> DataFrame:
    """One row per non-empty (trimmed) list element."""
    e = df.select(*keep, F.explode(F.transform(list_col, lambda x: F.trim(x))).alias(name))
    return e.where(F.col(name) != "")


def _ranked(e: DataFrame, key: str, top_n: int | None) -> DataFrame:
    out = e.groupBy(key).agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), F.asc(key))
    return out.limit(top_n) if top_n else out


def hashtag_ranking(df: DataFrame, top_n: int | None = 20) -> DataFrame:
    return _ranked(exploded_tags(df, "hashtag_list", "hashtag"), "hashtag", top_n)


def hashtag_year_trend(df: DataFrame, top_n: int = 10) -> DataFrame:
    out = top_keys_by_period(exploded_tags(df, "hashtag_list", "hashtag", "year"), "hashtag", ["year"], top_n)
    return out.select("year", "hashtag", "occurrences").orderBy(
        F.asc("year"), F.desc("occurrences"), F.asc("hashtag"))


def _clean_tags() -> F.Column:
    return F.filter(F.transform("hashtag_list", lambda x: F.trim(x)), lambda x: x != "")


def hashtag_pairs_raw(df: DataFrame) -> DataFrame:
    """Every unordered pair of distinct tags within each post (tweet_id, tag_a, tag_b)."""
    return PR.pairs_per_post(df, "tweet_id", _clean_tags(), names=("tag_a", "tag_b"))


def hashtag_cooccurrence(df: DataFrame, top_n: int | None = 50, min_count: int = 2) -> DataFrame:
    return PR.top_pairs(df, "tweet_id", _clean_tags(), top_n=top_n, min_count=min_count, names=("tag_a", "tag_b"))


def cooccurrence_nodes(pairs: DataFrame, a: str = "tag_a", b: str = "tag_b") -> DataFrame:
    return PR.pair_nodes(pairs, a, b)


def cooccurrence_degree(pairs: DataFrame, a: str = "tag_a", b: str = "tag_b") -> DataFrame:
    return PR.pair_degree(pairs, a, b)


def mention_ranking(df: DataFrame, top_n: int | None = 20) -> DataFrame:
    return _ranked(exploded_tags(df, "mention_list", "mention"), "mention", top_n)


def mention_weekday_counts(df: DataFrame) -> DataFrame:
    e = exploded_tags(df, "mention_list", "mention", "weekday")
    return (e.groupBy("weekday", "mention").agg(F.count(F.lit(1)).alias("occurrences"))
            .orderBy(F.asc("weekday"), F.desc("occurrences"), F.asc("mention")))


def mention_weekday_totals(df: DataFrame) -> DataFrame:
    return (exploded_tags(df, "mention_list", "mention", "weekday").groupBy("weekday").agg(F.count(F.lit(1)).alias("occurrences"))
            .withColumn("weekday_label", C.weekday_label(F.col("weekday"))).orderBy("weekday"))


def mention_weekday_top(df: DataFrame, top_n: int = 5) -> DataFrame:
    """Weekday counts for the top mentions only.  The ranking is taken from the
    same per-(weekday, mention) aggregate (one pass over the posts); the top list
    has at most top_n keys (broadcast)."""
    per = (exploded_tags(df, "mention_list", "mention", "weekday")
           .groupBy("weekday", "mention").agg(F.count(F.lit(1)).alias("occurrences")))
    top = (per.groupBy("mention").agg(F.sum("occurrences").alias("total"))
           .orderBy(F.desc("total"), F.asc("mention")).limit(top_n).select("mention"))
    return (per.join(F.broadcast(top), "mention", "left_semi")
            .select("weekday", "mention", "occurrences",
                    C.weekday_label(F.col("weekday")).alias("weekday_label"))
            .orderBy(F.asc("weekday"), F.desc("occurrences"), F.asc("mention")))


# ---------------------------------------------------------------------------
# Keyword dictionary
# ---------------------------------------------------------------------------

def _entry(line: str) -> tuple[str, list[str]] | None:
    """Label and terms of a line, or nothing if either is missing."""
    colon = ":" if ":" in line else "："
    label, found, rest = (part.strip() for part in line.partition(colon))
    terms = [t for t in map(str.strip, rest.replace("、", ",").split(",")) if t]
    return (label, terms) if found and label and terms else None


def parse_keyword_dictionary(raw: str | None) -> list[tuple[str, list[str]]]:
    """(label, terms) of a keyword setting, one entry a line.

    Rule: the label ends at the first ASCII colon, or without one at the first
    full-width colon.  Terms are separated by ',' or '、'.  Labels and terms are trimmed;
    lines without a colon, a label or a term say nothing.  A label given again keeps
    its place and takes the later terms.  This reads a small setting, not data.
    """
    return [*dict(filter(None, map(_entry, (raw or "").splitlines()))).items()]


def _char_class(chars: Iterable[str]) -> str:
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in chars) + "]"


def _branches(children: dict[str, str]) -> str:
    """Alternatives by first character.  Many are halved by look-ahead, so that a position
    costs the logarithm of their number, as in a search tree."""
    chars = sorted(children)
    if len(chars) <= 4:
        return "|".join(f"\\x{{{ord(c):X}}}{children[c]}" for c in chars)
    half = len(chars) // 2
    low, high = ({c: children[c] for c in part} for part in (chars[:half], chars[half:]))
    return f"(?={_char_class(low)})(?:{_branches(low)})|{_branches(high)}"


def terms_pattern(terms: Iterable[str]) -> str:
    """One regular expression for all terms: their trie, longer terms before shorter ones.

    It is a look-ahead, so a search stops at every position where a term begins, overlaps
    included, with the longest such term as group 1; the others there are its prefixes.
    """
    trie: dict = {}
    for term in terms:
        node = trie
        for c in term:
            node = node.setdefault(c, {})
        node[""] = {}
    done: dict[int, str] = {}
    walk = [(trie, False)]
    while walk:  # children before their node, without recursion
        node, ready = walk.pop()
        below = {c: n for c, n in node.items() if c}
        if not ready:
            walk += [(node, True), *((n, False) for n in below.values())]
        elif below:
            done[id(node)] = f"(?:{_branches({c: done[id(n)] for c, n in below.items()})}){'?' if '' in node else ''}"
        else:
            done[id(node)] = ""
    first = _char_class(sorted(trie))
    return f"(?={first})(?=({done[id(trie)]}))"


def _is_in(terms: list[str], t: Column) -> Column:
    return t.isin(terms)


def keyword_category_counts(df: DataFrame, keyword_dict: str | list) -> DataFrame:
    """Posts per category: a post counts once for a category when any of its terms
    occurs in the lower-cased text.

    One search of each text by :func:`terms_pattern` finds the longest term at every
    position, whatever their number; a category has a post if one of the found terms has
    one of the category's terms as a prefix, which is a set made beforehand.  One
    conditional count per category, then unpivoted; categories with no posts stay with 0.
    """
    entries = parse_keyword_dictionary(keyword_dict) if isinstance(keyword_dict, str) else list(keyword_dict)
    spark = df.sparkSession
    if not entries:
        return spark.createDataFrame([], "category string, posts bigint")
    lowered = [[t.lower() for t in terms] for _, terms in entries]
    every = sorted({t for terms in lowered for t in terms})
    holders: dict[str, set[int]] = {}
    for i, terms in enumerate(lowered):
        for t in terms:
            holders.setdefault(t, set()).add(i)
    implied = [[] for _ in entries]  # terms that begin with one of the category's
    for t in every:
        for i in set().union(*(holders.get(t[:k], set()) for k in range(1, len(t) + 1))):
            implied[i].append(t)
    found = F.array_distinct(F.regexp_extract_all(F.lower(F.col("text")), F.lit(terms_pattern(every)), F.lit(1)))
    counts = [F.count_if(F.exists("_found", partial(_is_in, own))).alias(f"c{i}") for i, own in enumerate(implied)]
    wide = df.select(found.alias("_found")).agg(*counts)
    stack = F.explode(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(label).alias("category"), F.col(f"c{i}").alias("posts"))
        for i, (label, _) in enumerate(entries)])).alias("r")
    return (wide.select(stack).select("r.ord", "r.category", "r.posts")
            .orderBy(F.desc("posts"), F.asc("ord")).select("category", "posts"))
