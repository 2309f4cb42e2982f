"""Cut points that survive the loss of executors.

A cut point is a Parquet table in the shared folder named by ``spark.checkpoint.dir``; every
executor reads it, so a lost executor costs a re-read and never a recomputation. Parquet is used
rather than ``checkpoint()`` where the data are wide, since it is compressed and column-pruned.
Every table is noted, so that ``discard_all`` can remove what a finished query has left.
"""

from __future__ import annotations

import atexit
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_at_exit: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; one beside the warehouse where a local session sets none."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_cut_points"
    if folder not in _at_exit:
        _at_exit.add(folder)
        atexit.register(shutil.rmtree, folder.removeprefix("file:"), True)
    return folder


def stored_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and return a reader of it."""
    path = stored_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table written by this module."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
    if path in _written:
        _written.remove(path)


def discard_tables(df: DataFrame) -> None:
    """Remove the cut points that a reader from ``stored`` reads, once nothing needs it any more."""
    for path in [p for p in _written if any(p in f for f in df.inputFiles()[:1])]:
        discard(df.sparkSession, path)


def discard_all(spark: SparkSession) -> None:
    """Remove every cut point of this process: results that still read one can then not be read again."""
    for path in list(_written):
        discard(spark, path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)


def touch(spark: SparkSession, path: str) -> None:
    """Make an empty file: a mark that something is done, without a job."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).create(jvm_path, True).close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(jvm_path)) if files.exists(jvm_path) else []


def partitions_of(spark: SparkSession) -> int:
    """The session's shuffle width, which the deployment sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
