"""Spark session helpers.

Every operator in this package is a plain ``DataFrame -> DataFrame`` function and
works with whatever session the caller already has.  The helpers here only build
a session for scripts and tests, and resolve the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import SparkSession

# Settings every session built here gets.  AQE re-plans joins and partition counts
# from runtime sizes (this is also the size check behind every join we leave to
# the optimiser), and splits skewed shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "postlens",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """Folder that the session names and all executors see: ``spark.checkpoint.dir`` or,
    where that is unset, ``spark.sql.warehouse.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.partition(":")[0] in ("file", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df):
    """Keep ``df`` once computed, for intermediates that several branches of a plan read
    (column pruning makes those branches differ, so Spark could not reuse one exchange
    for them and would recompute e.g. the tokenisation).  Partitions that do not fit
    in memory go to disk; those lost with an executor are computed again."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def checkpointed(df):
    """``df`` computed and written to the shared folder, its plan cut there: for steps that
    repeat, whose plans would otherwise grow into each other."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_root(df.sparkSession).rstrip('/')}/_checkpoints")
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
