"""Intermediate tables in the shared folder: lineage ends there, lost executors can read them again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``); only a local master may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder there")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _located(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def exists(spark: SparkSession, path: str) -> bool:
    system, found = _located(spark, path)
    return system.exists(found)


def status_of(spark: SparkSession, path: str) -> list:
    """[size, time of change] of a file, or [] if it is not there."""
    system, found = _located(spark, path)
    if not system.exists(found):
        return []
    status = system.getFileStatus(found)
    return [status.getLen(), status.getModificationTime()]


def qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark's readers name it in ``_metadata.file_path``, but for slashes after ``file:``."""
    system, found = _located(spark, path)
    return re.sub("^file:/+", "/", spark._jvm.org.apache.spark.paths.SparkPath.fromPath(system.makeQualified(found)).urlEncoded())


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop(spark, path)
    except Exception:  # the session has ended, and its folder with it
        pass


#: Rows that a task holds at once where it groups, sorts or joins a large table.
TASK_ROWS = 200_000


def parts_of(rows: int) -> int:
    """Partitions of a table of so many rows: a fixed number would make tasks that grow with the table."""
    return max(1, -(-rows // TASK_ROWS))


def materialised(df: DataFrame, *by: str) -> DataFrame:
    """``df`` written once (a folder a value of ``by``) and read back; for what a plan uses several times.  The table goes with the process."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandlake-table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    atexit.register(_drop_quietly, spark, path)
    return spark.read.schema(df.schema).parquet(path)
