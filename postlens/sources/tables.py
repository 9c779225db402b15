"""Post tables built from the driver's parquet tables.

The engine works on any table of posts ``(tweet_id, created_at, text, status_url
[, author_id])``.  For checks and benchmarks we derive two such tables from the
given tables with ordinary Spark joins -- whole tables, whole texts:

* ``stream_posts``: one post per row of ``events`` (30 days of microsecond
  timestamps, many authors).  Each event is joined 1:1 to the whole text of the
  document with the same id and to the URL of the page with the same id; the
  event's own fields add a reply / retweet prefix, tags, a self status link and
  a code marker, chosen by ``event_type``.
* ``archive_posts``: one post per row of ``orders`` (several years of dates),
  joined the same way to documents and pages.  Used by year / month / ISO-week
  operators.

The oracle SQL in ``plans.oracle`` builds the same two views in DuckDB.

Document and page ids are keys.  The joined sides are written as one row per id
(``groupBy(id)``; a duplicated id would keep its largest value), which lets
Catalyst prove the left joins cannot add rows: a query that uses no text or URL
(calendar counts, intervals, sessions) then drops those joins and never reads
the documents or pages at all.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _s(c) -> F.Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("doc_id").agg(F.max("text").alias("doc_text"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.groupBy("page_id").agg(F.max("url").alias("page_url"))


def _with_texts(rows: DataFrame, key, docs: DataFrame) -> DataFrame:
    """``rows`` with the text of the document of their ``key``.

    The narrow side is dealt to the documents by id.  Texts are never broadcast, however
    few they are: that would leave all work on them to the scan tasks of the other table.
    """
    return rows.join(docs.hint("merge"), key == docs.doc_id, "left")


def stream_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    d, p = _documents(spark, sf_dir), _pages(spark, sf_dir)
    j = (_with_texts(e, e.event_id, d)
          .join(p, e.event_id == p.page_id, "left"))
    uid, eid, etype = _s(F.col("user_id")), _s(F.col("event_id")), _s(F.col("event_type"))
    prefix = (F.when(etype == "signup", F.concat(F.lit("RT @user"), uid, F.lit(": ")))
               .when(etype == "click", F.concat(F.lit("@user"), uid, F.lit(" ")))
               .otherwise(F.lit("")))
    body = F.coalesce(F.col("doc_text"), F.concat(etype, F.lit(" "), _s(F.col("props"))))
    k_tag = F.concat(F.lit(" #k"), F.regexp_extract(_s(F.col("props")), "[0-9]+", 0))
    page = F.when(F.col("page_url").isNotNull(), F.concat(F.lit(" "), F.col("page_url"))).otherwise(F.lit(""))
    status = F.concat(F.lit("https://x.com/u"), uid, F.lit("/status/"), eid)
    self_link = F.when(etype == "purchase", F.concat(F.lit(" "), status, F.lit("?s=20"))).otherwise(F.lit(""))
    code = F.when(etype == "error", F.lit(" def import \U0001F600☀")).otherwise(F.lit(""))
    text = F.concat(prefix, body, F.lit(" #"), etype, k_tag, page, self_link, code)
    return j.select(eid.alias("tweet_id"), F.col("ts").alias("created_at"), text.alias("text"),
                    status.alias("status_url"), F.col("user_id").alias("author_id"))


def archive_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate",
                                              "o_orderpriority")
    d, p = _documents(spark, sf_dir), _pages(spark, sf_dir)
    j = (_with_texts(o, o.o_orderkey, d)
          .join(p, o.o_orderkey == p.page_id, "left"))
    key, cust = _s(F.col("o_orderkey")), _s(F.col("o_custkey"))
    status, prio = _s(F.col("o_orderstatus")), _s(F.col("o_orderpriority"))
    body = F.coalesce(F.col("doc_text"), F.concat(prio, F.lit(" "), status))
    page = F.when(F.col("page_url").isNotNull(), F.concat(F.lit(" "), F.col("page_url"))).otherwise(F.lit(""))
    text = F.concat(body, F.lit(" #status"), status, F.lit(" #p"), F.substring(prio, 1, 1), page)
    status_url = F.concat(F.lit("https://x.com/c"), cust, F.lit("/status/"), key)
    return j.select(key.alias("tweet_id"), F.col("o_orderdate").alias("created_at"), text.alias("text"),
                    status_url.alias("status_url"), F.col("o_custkey").alias("author_id"))
