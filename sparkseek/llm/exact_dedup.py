"""Exact dedup against a persistent index of text digests.

The index is a Parquet table of (digest, keep_id, keep_row, batch), bucketed and sorted by digest, at a folder that outlives the
session. A batch is reduced to one record per digest, map side first; a sort-merge anti-join finds the digests that the
index lacks, reading its buckets in place, and those are appended. The document that an index names first for a digest
stays for good; within one batch that is the one with the smallest doc_id. Each entry names its batch, so of a batch that
is added again, with the same documents in the same rows, nothing stays.

Defined results: a null text counts as empty; a null doc_id sorts behind all others; of rows with equal text and equal
doc_id one stays; an empty batch gives no rows and leaves the index as it is; columns besides doc_id and text pass
through `kept` and are otherwise ignored. Texts of any length are hashed whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, free_name, join_groups, numbered_rows, written


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """A digest index at a folder that every executor can reach; created when the folder holds none."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        layout = f"{self.path}/layout"
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("ignore").parquet(layout)
        self.buckets = spark.read.parquet(layout).first().buckets
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/digests'"
        )

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, docs: DataFrame, row: str | None = None) -> DataFrame:
        """Take in a batch. One row per document: row, doc_id, digest, keep_id, keep_row, batch, group_size (within the batch), kept.

        keep_row is a row of the batch that brought the digest. `row` of the result numbers the rows of `docs`, with the
        numbers of the column `row` if it is given.
        """
        batch = uuid.uuid4().hex
        number = F.monotonically_increasing_id() if row is None else F.col(row)
        rows = written(docs.select(number.alias("row"), F.col("doc_id").cast("long"), digest(F.col("text")).alias("digest")), "digests")
        first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))
        groups = written(rows.groupBy("digest").agg(first.alias("first"), F.count("*").alias("group_size")), "digest-groups")
        new = groups.join(self.entries().hint("merge"), "digest", "left_anti")
        new = new.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.lit(batch).alias("batch"))
        new.write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)

        # A digest that an earlier batch brought keeps that batch's document, so nothing of this batch stays.
        added = self.entries().join(groups, "digest").select("digest", "keep_id", "keep_row", "batch", "group_size")
        found = join_groups(rows, added, "digest", "group_size", groups.agg(F.sum("group_size")).first()[0] or 0)
        return found.withColumn("kept", F.col("batch").eqNullSafe(F.lit(batch)) & (F.col("row") == F.col("keep_row")))

    def kept(self, docs: DataFrame) -> DataFrame:
        """The documents of a batch that stay, with all their columns."""
        row = free_name(docs, "row")
        docs = numbered_rows(docs, row)
        gone = self.add(docs, row).filter(~F.col("kept")).select(F.col("row").alias(row))
        return docs.join(gone, row, "left_anti").drop(row)
