"""Derived columns (one row in, one row out) and row filters."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C


def derive(posts: DataFrame) -> DataFrame:
    """Add the calendar, length, URL, tag, mention, domain, reply, code and
    language columns in a single projection.

    Output schema: tweet_id, created_at, text (never null), status_url, date, year,
    month, weekday (Mon=0), hour, text_length, urls, url_count, hashtag_list,
    hashtag_count, mention_list, mention_count, domains, is_reply, contains_code,
    language_hint, plus any further input columns (e.g. author_id).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = posts.withColumn("text", text)
    t = F.col("text")
    cols = {}
    if "created_at" in posts.columns:
        ts = F.col("created_at")
        cols.update({
            "date": F.to_date(ts),
            "year": F.year(ts),
            "month": F.month(ts),
            "weekday": F.weekday(ts),
            "hour": F.hour(ts),
        })
    cols.update({
        "text_length": F.char_length(t),
        "urls": C.urls(t),
        "hashtag_list": C.hashtags(t),
        "mention_list": C.mentions(t),
        "is_reply": t.startswith("@"),
        "contains_code": C.contains_code(t),
        "language_hint": C.language_hint(t),
    })
    df = df.withColumns(cols)
    return df.withColumns({
        "url_count": F.size("urls"),
        "hashtag_count": F.size("hashtag_list"),
        "mention_count": F.size("mention_list"),
        "domains": C.domains(F.col("urls")),
    })


def filter_years(df: DataFrame, years: Sequence[int] | None, years_mode: str = "selected") -> DataFrame:
    """Keep rows whose year is listed; no list (or mode 'all') keeps everything.

    On a table written with ``partitionBy('year')`` this filter prunes partitions.
    """
    if years_mode != "selected" or not years or "year" not in df.columns:
        return df
    return df.where(F.col("year").isin([int(y) for y in years]))


def exclude_retweets(df: DataFrame, exclude: bool = True) -> DataFrame:
    """Drop posts whose text starts with 'RT' (the pattern ``^RT\\s*@?`` accepts any
    text that starts with RT, including e.g. 'RTX')."""
    if not exclude:
        return df
    return df.where(~F.col("text").startswith("RT"))


def available_years(df: DataFrame) -> DataFrame:
    return df.where(F.col("year").isNotNull()).select("year").distinct().orderBy("year")
