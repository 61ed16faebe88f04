"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on one machine, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="patchloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file through Spark's own file systems."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for k in range(0, len(data), 1 << 22):
            out.write(bytearray(data[k : k + (1 << 22)]))
    finally:
        out.close()


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/patchloom/{label}-{uuid.uuid4().hex}"

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may have ended already
            pass

    atexit.register(clean)
    return path


def keep(df: DataFrame, label: str = "kept", **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.options(**{"compression": "zstd"} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def merged_join(left: DataFrame, right: DataFrame, on: Column | str | list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: both are dealt by key and merged in tasks.

    Left to itself, Spark sends a table of few compressed bytes to all executors through the driver, and rows that are much alike take many times as much there.
    """
    return left.join(right.hint("merge"), on, how)
