"""Keys that occur in more than one document, found block by block.

Documents are dealt by a hash into blocks of bounded bytes. A block reports each of its keys once, with a mark: the block's
number, and whether several of its documents have the key. So a key that a third of all documents hold is one row per
block. Keys of several documents go back to the blocks that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK_BYTES = 8 << 20


def block_of(total: int, *keys: Column, block_bytes: int = BLOCK_BYTES) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(1 + total // block_bytes))


def several(key: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys, and which of them occur with several documents."""
    order = np.lexsort((document, key))
    key, document = key[order], document[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    other = np.zeros(len(key), dtype=bool)
    other[1:] = ~new[1:] & (document[1:] != document[:-1])
    start = np.flatnonzero(new)
    return key[start], (np.add.reduceat(other, start) > 0) if len(start) else np.zeros(0, dtype=bool)


def marked(block: int, many: np.ndarray) -> pa.Array:
    return pa.array(np.int64(block) * 2 + many.astype(np.int64))


def of_several(reported: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Reported rows (keys, mark) of keys that several documents hold, with block instead of mark and `more` over all rows of a key."""
    rows = Window.partitionBy(*keys)
    more = {name: column.over(rows) for name, column in more.items()}
    seen = reported.select("*", F.count("*").over(rows).alias("blocks_"), F.max(F.col("mark").bitwiseAND(F.lit(1))).over(rows).alias("many_"),
                           *[column.alias(name) for name, column in more.items()])
    return seen.filter("blocks_ > 1 OR many_ = 1").withColumn("block", F.shiftright("mark", 1))
