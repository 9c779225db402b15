"""Incremental ingest with Structured Streaming.

New archive files (CSV exports or Parquet) dropped into a folder are read as a
stream, given the derived columns, and appended to the year-partitioned posts
table.  Each CSV file is judged by itself (encoding, header, column roles, see
``sources.csv_ingest``), also files that come later, and large ones are read in
splits: the stream only carries the names of new files, and each micro-batch reads
its files as ``read_posts_csv`` does.

Progress is kept in a checkpoint beside the table (its full path with
``.checkpoint``), so a restarted or failed job, in this or a new session, takes every
file exactly once, and tables of one name in different folders keep apart.  A batch of
CSV files is written to partitions named after its files; one that is repeated after a
failure replaces what it had written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.derive import derive
from ..sources import csv_ingest as CSV
from ..sources.posts_table import BATCH, WRITTEN

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def posts_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of raw posts (tweet_id, created_at, text, status_url) from Parquet files."""
    reader = spark.readStream.schema(spark.read.parquet(source_dir).schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(source_dir)


def file_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of the paths of new files; their content is not read."""
    reader = spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source_dir).select("path")


def append_csv_files(files: DataFrame, table_path: str) -> None:
    """Derived posts of the named CSV files into partitions of their own."""
    paths = sorted(r["path"] for r in files.distinct().collect())  # the files of one micro-batch
    filled = [r["path"] for r in files.sparkSession.read.format("binaryFile").load(paths).where("length > 0").select("path").collect()] if paths else []
    if not filled:
        return
    name = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:16]
    posts = derive(CSV.read_posts_csv(files.sparkSession, sorted(filled)))
    (posts.withColumn(BATCH, F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("year", BATCH).parquet(table_path))


def start_ingest(spark: SparkSession, source_dir: str, table_path: str, fmt: str = "csv",
                 checkpoint: str | None = None, available_now: bool = True,
                 processing_time: str = "1 minute", max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append derived posts from ``source_dir`` to the year-partitioned table at
    ``table_path``.  ``available_now`` processes what is there and stops;
    otherwise the query keeps polling every ``processing_time``."""
    checkpoint = checkpoint or table_path.rstrip("/") + ".checkpoint"
    if fmt == "parquet":
        posts = derive(posts_stream(spark, source_dir, max_files_per_trigger)).withColumn(BATCH, F.lit(WRITTEN))
        writer = posts.writeStream.format("parquet").option("path", table_path).partitionBy("year", BATCH).outputMode("append")
    else:
        writer = (file_stream(spark, source_dir, max_files_per_trigger).writeStream
                  .foreachBatch(lambda files, _: append_csv_files(files, table_path)))
    writer = writer.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start()
