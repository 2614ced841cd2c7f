"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import new_folder, written

__all__ = ["table", "free_name", "join_groups", "new_folder", "numbered_rows", "total_bytes", "written"]

#: ASCII white space, as the contracts of the word-based operators write it.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the frame doesn't use; names differ from each other without regard to case."""
    used = {name.lower() for name in df.columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of rows with one record per group, safe when one group holds most of the rows.

    `size` is the number of rows of a group and `total` that of all rows. Fewer than `parts` groups can hold more than
    total / parts rows each, so those are broadcast; no key of the shuffled join holds more than total / parts rows.
    """
    large = F.col(size) > total // parts
    hot = F.broadcast(groups.filter(large))
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(groups.filter(~large), key))


def numbered_rows(rows: DataFrame, name: str = "row") -> DataFrame:
    """The frame with a number for each row, written once: every pass reads the number from that table, so it is the same
    for a row whichever executors take part and however files are split. Texts fill it, so it is packed tightly."""
    return written(rows.withColumn(name, F.monotonically_increasing_id()), "numbered-rows", "zstd")


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def total_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(utf8_size(F.col(text)))).first()[0] or 0
