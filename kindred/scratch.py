"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: set[str] = set()
_cleaning, _writers = threading.Lock(), [0, ""]


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a folder of our own, but only if all tasks run in this process:
    executors elsewhere would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            found = known.get()
        elif not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="kindred-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; ``release`` (also run at exit) deletes it."""
    path = f"{shared_dir(spark)}/kindred/{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(release)
    _made.add(path)
    return path


def release(*paths: str) -> None:
    """Delete the given scratch folders, or all that this process made."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths or tuple(_made):
        at = jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(conf).delete(at, True)
        _made.discard(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts the lineage: what follows is recomputed from the table when an executor is lost, and rows that depend on
    the partitioning (task numbers, running indexes) keep the values that were committed.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _cleaning:  # the finished job's shuffle files go at once; the table has all that is needed
        if not _writers[0]:
            _writers[1] = spark.conf.get(CLEANUP)
            spark.conf.set(CLEANUP, "true")
        _writers[0] += 1
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with _cleaning:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(CLEANUP, _writers[1])
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that ``materialise`` gave and that nothing reads any more."""
    release(df._scratch)
