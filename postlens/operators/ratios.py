"""Single-row ratio summaries: each is one partial aggregation over the posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def _rate(part: Column, total: Column) -> Column:
    return F.when(total > 0, C.round_half_up(part / total, 4)).otherwise(F.lit(0.0))


def _two_way(df: DataFrame, cond: Column, yes: str, no: str) -> DataFrame:
    agg = df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias(yes), F.count(F.lit(1)).alias("_n"))
    return agg.select(yes, (F.col("_n") - F.col(yes)).alias(no), _rate(F.col(yes), F.col("_n")).alias("rate"))


def reply_ratio(df: DataFrame) -> DataFrame:
    return _two_way(df, F.col("is_reply"), "reply", "non_reply")


def night_post_ratio(df: DataFrame) -> DataFrame:
    """Posts made 00:00-05:59; posts without a time count in the total only."""
    return _two_way(df, F.col("hour").between(0, 5), "night", "daytime")


def url_presence_stats(df: DataFrame) -> DataFrame:
    return _two_way(df, F.col("url_count") > 0, "with_url", "without_url")


def self_reference_stats(df: DataFrame, strict_self_domain: bool = False) -> DataFrame:
    """Posts linking to the platform's own domains; 'external' is everything else,
    posts without any URL included."""
    return _two_way(df, F.exists("domains", lambda d: C.is_self_domain(d, strict_self_domain)), "self_ref", "external")


def _strip_status(url: Column) -> Column:
    return F.substring_index(F.substring_index(url, "?", 1), "#", 1)


def self_post_url_stats(df: DataFrame) -> DataFrame:
    """Posts linking to their own status URL (query / fragment ignored), posts with
    other URLs, posts without URLs, and the self-link rate over all posts."""
    status = _strip_status(F.coalesce(F.col("status_url").cast("string"), F.lit("")))
    has_url = F.size("urls") > 0
    own = has_url & (status != "") & F.exists("urls", lambda u: _strip_status(u) == status)
    agg = df.agg(F.count_if(own).alias("self_post"), F.count_if(has_url & ~own).alias("other_url"),
                 F.count_if(~has_url).alias("no_url"), F.count(F.lit(1)).alias("_n"))
    return agg.select("self_post", "other_url", "no_url", _rate(F.col("self_post"), F.col("_n")).alias("rate"))
