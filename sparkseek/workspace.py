"""Written intermediate tables.

A result that several later steps read is written once as parquet and read back. That cuts lineage, survives lost
executors, and gives the planner true sizes. The folder is the shared one named by `spark.checkpoint.dir`; only a
local session without that setting gets a temporary folder. Each application writes below a folder of its own and can
clear it at its end.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .sources.shared_files import open_fs

_LOCAL_ROOT: str | None = None


def shared_root(spark: SparkSession) -> str:
    global _LOCAL_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/") + "/sparkseek"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="sparkseek-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT, ignore_errors=True)
    return _LOCAL_ROOT


def _own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_own_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written here. For its end: frames that read it can't be used any more."""
    path, fs = open_fs(spark, _own_root(spark))
    fs.delete(path, True)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The frame, written to a new folder and read back; `compression` names another codec than the session's."""
    path = new_folder(df.sparkSession, name)
    writer = df.write if compression is None else df.write.option("compression", compression)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
