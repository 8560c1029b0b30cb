"""Tables that a run leaves in the folder that the driver and all executors share.

What is written there is committed whole by Spark and read back as files: a plan over it sees the
same rows and places each time, whatever was pruned, merged or lost meanwhile.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_left: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, or on one machine a folder of our own."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or tempfile.mkdtemp(prefix="siftline-")
        found = _own
    found = found.rstrip("/")
    return found if "://" in found or found.startswith("file:") else f"file://{found}"


def fresh(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to."""
    path = f"{folder(spark)}/siftline/{name}-{uuid.uuid4().hex}"
    _left.append(path)
    return path


def hadoop(spark: SparkSession, name: str):
    """File system and path of ``name``, by Hadoop's own client."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, name: str) -> bool:
    """Whether there is a file or folder of this name, or any that a pattern stands for."""
    fs, path = hadoop(spark, name)
    return fs.exists(path) or len(fs.globStatus(path) or ()) > 0


def delete(spark: SparkSession, name: str) -> None:
    fs, path = hadoop(spark, name)
    fs.delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` from files in the shared folder."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Delete what this process has left there; results that still read it are lost."""
    while _left:
        delete(spark, _left.pop())
