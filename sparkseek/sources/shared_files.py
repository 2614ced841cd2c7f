"""Files of any shared file system, through Hadoop."""

from __future__ import annotations

from pyspark.sql import SparkSession


def open_fs(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = open_fs(spark, path)
    return fs.exists(p)
