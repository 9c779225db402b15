"""Shared folder and checkpoints for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import hashlib
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder: ``spark.checkpoint.dir``.

    Where the session leaves it unset (local runs, tests) a folder inside
    ``spark.sql.warehouse.dir`` is used, which the session names as well.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path
    warehouse = spark.conf.get("spark.sql.warehouse.dir")
    if not spark.sparkContext.master.startswith("local") and warehouse.partition(":")[0] in ("file", warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return warehouse.rstrip("/") + "/_checkpoints"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of intermediate tables in the shared folder, not yet made."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: for large intermediates, which take a
    fraction of a checkpoint's disk and are read by column.  The shuffles behind it are not
    kept; :func:`delete` it once what reads it is written itself."""
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _file(spark, path)
    return files.exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """A folder of intermediate results that this package has written."""
    files, at = _file(spark, path)
    files.delete(at, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Jobs begun inside give the files of their shuffles back when they end, so that a
    sequence of steps needs the disk of its largest step and not that of all together.
    What they have written stays; the session's own setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the files are in the shared folder, so the result
    survives the loss of any executor, and the shuffles behind it are not kept."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    with shuffles_dropped(spark):
        # The plan is made here: it takes the setting that holds now.
        return df.select("*").checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this subpackage, also where only the driver has it.

    The zip is handed to Spark's own file server, which every executor reads; the
    driver's copy is only its source.
    """
    sc = spark.sparkContext
    here = Path(__file__).resolve().parent
    files = [here.parent / "__init__.py", *sorted(here.glob("*.py"))]
    digest = hashlib.sha256(b"".join(p.name.encode() + p.read_bytes() for p in files)).hexdigest()[:16]
    name = f"{here.parent.name}-{here.name}-{digest}.zip"
    if any(Path(p).name == name for p in sc._python_includes):
        return
    target = Path(sc._temp_dir or ".") / name
    with zipfile.ZipFile(target, "w") as z:
        for p in files:
            z.write(p, p.relative_to(here.parent.parent))
    sc.addPyFile(str(target))


def trim() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    freed = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if freed is not None:
        freed(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for ``mapInArrow``, giving freed memory back to the system when a task ends.

    Worker processes live on in later stages; what one task needed at most would
    otherwise stay theirs.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped
