"""Per-post distributions (histograms).  All are partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _dist(df: DataFrame, key, name: str) -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("posts")).orderBy(name)


def text_length_distribution(df: DataFrame, bin_size: int = 20) -> DataFrame:
    """Fixed-width bins of text length: bin_start, bin_end (= start + size - 1),
    posts, bin_label 'start-end'."""
    if bin_size <= 0:
        bin_size = 20
    start = (F.floor(F.col("text_length") / F.lit(bin_size)) * F.lit(bin_size)).cast("bigint")
    out = (df.where(F.col("text_length").isNotNull())
           .groupBy(start.alias("bin_start")).agg(F.count(F.lit(1)).alias("posts"))
           .withColumn("bin_end", F.col("bin_start") + F.lit(bin_size - 1)))
    return out.select("bin_start", "bin_end", "posts",
                      F.concat_ws("-", F.col("bin_start").cast("string"),
                                  F.col("bin_end").cast("string")).alias("bin_label")).orderBy("bin_start")


def url_count_distribution(df: DataFrame) -> DataFrame:
    return _dist(df.where(F.col("url_count").isNotNull()), F.col("url_count").cast("bigint"), "url_count")


def newline_count_distribution(df: DataFrame) -> DataFrame:
    return _dist(df, C.newline_count(F.coalesce(F.col("text"), F.lit(""))).cast("bigint"), "newlines")


def emoji_count_distribution(df: DataFrame) -> DataFrame:
    return _dist(df, C.emoji_count(F.coalesce(F.col("text"), F.lit(""))).cast("bigint"), "emojis")


def hashtag_count_distribution(df: DataFrame) -> DataFrame:
    return _dist(df, F.coalesce(F.col("hashtag_count").cast("bigint"), F.lit(0).cast("bigint")), "hashtag_count")


def mention_count_distribution(df: DataFrame) -> DataFrame:
    return _dist(df, F.coalesce(F.col("mention_count").cast("bigint"), F.lit(0).cast("bigint")), "mention_count")


def path_depth_distribution(df: DataFrame, exclude_self_ref: bool = True, strict_self_domain: bool = False) -> DataFrame:
    """Per URL: scheme, '#...' and '?...' removed, depth = number of '/' parts - 1.
    Links to the platform's own domains are skipped by default."""
    u = df.select(F.explode("urls").alias("url"))
    trimmed = C.strip_query_fragment(C.strip_scheme(F.col("url")))
    parts = u.select(F.split(trimmed, "/").alias("parts"))
    if exclude_self_ref:
        parts = parts.where(~C.is_self_domain(F.col("parts")[0], strict_self_domain))
    return (parts.groupBy((F.size("parts") - 1).cast("bigint").alias("depth"))
            .agg(F.count(F.lit(1)).alias("occurrences")).orderBy("depth"))


def value_counts_topn(df: DataFrame, column: str, top_n: int | None = None) -> DataFrame:
    """Count per value of any column, most frequent first (ties by value)."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(column))
    return out.limit(top_n) if top_n else out


def long_text_ranking(df: DataFrame, top_n: int = 20) -> DataFrame:
    """Longest posts first (ties by tweet_id): tweet_id, created_at, text_length,
    text, status_url.  A top-N sort (TakeOrderedAndProject), no global sort."""
    cols = [c for c in ["tweet_id", "created_at", "text_length", "text", "status_url"] if c in df.columns]
    d = df.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    if "text_length" not in d.columns:
        d = d.withColumn("text_length", F.char_length("text"))
        cols = cols + ["text_length"]
    return d.select(*cols).orderBy(F.desc("text_length"), F.asc("tweet_id")).limit(top_n)
