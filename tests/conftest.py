import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from postlens.session import build_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="postlens-tests", shuffle_partitions=8,
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="postlens-test-ckpt-")})
    yield s
    s.stop()


def make_posts(spark, rows, with_author=False):
    """rows: (tweet_id, created_at 'YYYY-MM-DD HH:MM:SS[.ffffff]' or None, text, status_url[, author])"""
    from pyspark.sql import functions as F
    schema = "tweet_id string, created_at string, text string, status_url string" + (
        ", author_id bigint" if with_author else "")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
