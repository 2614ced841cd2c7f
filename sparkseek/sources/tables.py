"""Reading columnar tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Input below this many bytes per core is spread over the cores after reading. A small file is often one row group
# and would keep one core busy; inputs of normal size are left as the scan splits them.
SPREAD_BYTES_PER_CORE = 16 << 20


def input_bytes(spark: SparkSession, path: str) -> int:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getContentSummary(hadoop_path).getLength()


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, spread: bool = False) -> DataFrame:
    """A parquet table; `spread` evens out inputs too small to be split well."""
    df = spark.read.parquet(path)
    if columns:
        df = df.select(*columns)
    cores = spark.sparkContext.defaultParallelism
    if spread and input_bytes(spark, path) < SPREAD_BYTES_PER_CORE * cores:
        df = df.repartition(cores)
    return df
