"""The post views cover whole tables and whole texts."""
from pyspark.sql import functions as F

from conftest import SF_SMALL
from postlens.sources import tables as T


def test_every_event_and_order_is_a_post(spark):
    assert T.stream_posts(spark, SF_SMALL).count() == T.table(spark, SF_SMALL, "events").count()
    assert T.archive_posts(spark, SF_SMALL).count() == T.table(spark, SF_SMALL, "orders").count()


def test_documents_appear_whole(spark):
    docs = T.table(spark, SF_SMALL, "documents").select(F.col("doc_id").cast("string").alias("tweet_id"),
                                                        F.col("text").alias("doc_text"))
    for posts in (T.stream_posts(spark, SF_SMALL), T.archive_posts(spark, SF_SMALL)):
        joined = posts.join(docs, "tweet_id")
        assert joined.count() == docs.count()  # every document is used once
        assert joined.where(~F.col("text").contains(F.col("doc_text"))).count() == 0  # and in full


def test_pages_appear_whole(spark):
    pages = T.table(spark, SF_SMALL, "pages").select(F.col("page_id").cast("string").alias("tweet_id"), "url")
    joined = T.stream_posts(spark, SF_SMALL).join(pages, "tweet_id")
    assert joined.count() == pages.count()
    assert joined.where(~F.col("text").contains(F.col("url"))).count() == 0
