"""The derived posts table on storage: Parquet partitioned by year and, below, by what wrote it.

Writing the derived table once and reading it back means every later analysis
starts from the precomputed columns, and a year selection prunes whole
partitions at the scan.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Partition column below the year: the files of an ingest batch, or ``WRITTEN``.
BATCH = "ingest_batch"
WRITTEN = "written"


def write_posts_table(derived: DataFrame, path: str, mode: str = "error") -> str:
    """Write derived posts partitioned by year (null years go to their own partition).

    No repartition by year first: one year may hold a large share of all posts,
    and shuffling it into one task would serialise that share; each task writes
    its own file per year it holds instead."""
    derived.withColumn(BATCH, F.lit(WRITTEN)).write.mode(mode).partitionBy("year", BATCH).parquet(path)
    return path


def read_posts_table(spark: SparkSession, path: str, years: Sequence[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path).drop(BATCH)
    if years:
        df = df.where(F.col("year").isin([int(y) for y in years]))
    return df


def long_texts(spark: SparkSession, path: str, top_n: int = 100, years: Sequence[int] | None = None) -> DataFrame:
    """The longest texts of a stored table, as ``histograms.long_text_ranking`` ranks them.

    The table has the length of every text, so the ranking reads lengths and ids alone and
    keeps the place (file and row) of ``top_n`` rows.  Then only the files of those rows are
    read again, for their texts; texts are neither sorted nor shuffled."""
    table = spark.read.parquet(path)
    if years:
        table = table.where(F.col("year").isin([int(y) for y in years]))
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    order = [F.desc("text_length"), F.asc("tweet_id")]
    won = table.select("text_length", "tweet_id", *place).orderBy(*order).limit(int(top_n)).select("_file", "_row").collect()
    files = sorted({r["_file"] for r in won})
    rows = table.where(F.col("_metadata.file_path").isin(files)) if files else table.limit(0)
    rows = rows.select("tweet_id", "created_at", "text_length", "text", "status_url", *place)
    places = spark.createDataFrame([tuple(r) for r in won], "_file string, _row long")
    return rows.join(F.broadcast(places), ["_file", "_row"], "left_semi").drop("_file", "_row").orderBy(*order)
