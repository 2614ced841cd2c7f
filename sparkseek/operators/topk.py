"""Keeping the best rows of a task, so that only those are shuffled to a final ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import new_folder

# Rows scored against the query block at a time; bounds the memory of one score block.
BLOCK_ROWS = 1024
#: Rows that are gathered before they are cut to the best; more if the best alone are that many.
HELD_ROWS = 50_000


def query_blocks(rows: DataFrame, size: int, key: str) -> Iterator[list]:
    """The rows of a batch of queries in lists of about `size`, one at a time through the driver; rows of a key stay together."""
    parts = -(-rows.count() // size)
    if parts > 1:  # each block then reads its own folder, and the batch is computed once
        numbered = rows.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(parts)))
        path = new_folder(rows.sparkSession, "query-blocks")
        numbered.repartition("_block").write.partitionBy("_block").parquet(path)
        rows = rows.sparkSession.read.schema(numbered.schema).parquet(path)
    for part in range(parts):
        block = (rows.where(F.col("_block") == part).drop("_block") if parts > 1 else rows).collect()
        if block:
            yield block


def leading(block: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest values of each column; of equal values at the cut the first rows stay."""
    n = len(block)
    if n <= k:
        return tuple(np.indices(block.shape).reshape(2, -1))
    floor = np.partition(block, n - k, axis=0)[n - k]
    above, level = block > floor, block == floor
    keep = above | (level & (level.cumsum(axis=0) <= k - above.sum(axis=0)))
    return np.nonzero(keep)


class RunningBest:
    """The k best rows per group seen so far, by score and then by key order."""

    def __init__(self, k: int, groups: list[str], keys: list[str]):
        self.k, self.groups, self.keys = k, groups, keys
        self.parts: list[pd.DataFrame] = []
        self.rows = self.least = 0

    def add(self, part: pd.DataFrame) -> None:
        if len(part):
            self.parts.append(part)
            self.rows += len(part)
        if self.rows > max(HELD_ROWS, 2 * self.least):
            self._cut()

    def _cut(self) -> None:
        rows = pd.concat(self.parts, ignore_index=True)
        by = [*self.groups, "score", *self.keys]
        rows = rows.sort_values(by, ascending=[True] * len(self.groups) + [False] + [True] * len(self.keys))
        rows = rows[rows.groupby(self.groups, sort=False).cumcount() < self.k]
        self.parts, self.rows, self.least = [rows], len(rows), len(rows)

    def result(self) -> pd.DataFrame | None:
        if not self.parts:
            return None
        self._cut()
        return self.parts[0]
