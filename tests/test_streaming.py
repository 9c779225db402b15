"""Structured Streaming ingest: files in, derived year-partitioned table out."""
import os
import tempfile

from pyspark.sql import functions as F

from postlens.sources.posts_table import read_posts_table
from postlens.streaming.ingest import start_ingest


def _csv(path, rows):
    with open(path, "w", encoding="utf-8") as f:
        for r in rows:
            f.write(",".join('"' + v.replace('"', '""') + '"' for v in r) + "\n")


def test_ingest_appends_new_files(spark):
    src = tempfile.mkdtemp(prefix="postlens-src-")
    out = os.path.join(tempfile.mkdtemp(prefix="postlens-out-"), "posts")
    ck = tempfile.mkdtemp(prefix="postlens-ck-")
    rows1 = [(f"12345678901{i:02d}", f"2023-0{1 + i % 9}-01 10:00:00", f"first batch post number {i} #a" + (" https://e.com/x" if i % 3 == 0 else ""),
              f"https://x.com/me/status/{i}") for i in range(20)]
    _csv(os.path.join(src, "part1.csv"), rows1)
    q = start_ingest(spark, src, out, checkpoint=ck)
    q.awaitTermination(120)
    assert read_posts_table(spark, out).count() == 20
    rows2 = [(f"12345678902{i:02d}", f"2024-02-0{1 + i % 9} 10:00:00", f"second batch post {i} longer text here",
              f"https://x.com/me/status/9{i}") for i in range(7)]
    _csv(os.path.join(src, "part2.csv"), rows2)
    q = start_ingest(spark, src, out, checkpoint=ck)
    q.awaitTermination(120)
    t = read_posts_table(spark, out)
    assert t.count() == 27  # each file exactly once
    assert read_posts_table(spark, out, years=[2024]).count() == 7
    r = t.where("tweet_id = '1234567890100'").collect()[0]
    assert r["hashtag_list"] == ["#a"] and r["domains"] == ["e.com"]


def test_ingest_parquet_files(spark):
    from conftest import SF_SMALL
    from postlens.sources import tables as T
    src = os.path.join(tempfile.mkdtemp(prefix="postlens-psrc-"), "in")
    out = os.path.join(tempfile.mkdtemp(prefix="postlens-pout-"), "posts")
    posts = T.archive_posts(spark, SF_SMALL)
    posts.write.parquet(src)
    q = start_ingest(spark, src, out, fmt="parquet", checkpoint=tempfile.mkdtemp(prefix="postlens-pck-"))
    q.awaitTermination(120)
    t = read_posts_table(spark, out)
    assert t.count() == posts.count()
    years = {r["year"] for r in t.select("year").distinct().collect()}
    assert years == {r["year"] for r in posts.select(F.year("created_at").alias("year")).distinct().collect()}
