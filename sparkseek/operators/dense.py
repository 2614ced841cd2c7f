"""Exact k-nearest neighbours by cosine for a batch of query vectors.

Each task multiplies its own vectors with the query matrix and keeps its best k per query and store, so no pair of
query and vector is ever a row and only k rows per query, store and task are shuffled. Queries come in blocks of bounded
size, and a batch of any size in one pass over the vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..batches import release
from ..config import Limits
from .topk import BLOCK_ROWS, RunningBest, leading, query_blocks


def _unit_rows(vectors) -> np.ndarray:
    matrix = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    norms[norms == 0] = 1.0
    return matrix / norms[:, None]


def _rows_of(vectors: pa.Array) -> np.ndarray:
    """The same of a column of vectors; one that differs in length from the others is an error."""
    width = pc.list_value_length(vectors).unique()
    if len(width) != 1 or vectors.null_count:
        raise ValueError(f"vectors of lengths {width.to_pylist()}")
    return _unit_rows(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1))


def _candidates(vectors: DataFrame, blocks: list[Broadcast], id_field: T.StructField, k: int, keys: list[str]) -> DataFrame:
    """Best k per query, store and task, in one pass over the vectors for all blocks of queries (ids, matrix)."""
    schema = T.StructType([id_field] + [vectors.schema[c] for c in ["store", *keys]] + [T.StructField("score", T.DoubleType())])

    def nearest(batches):
        best = RunningBest(k, ["query_id", "store"], keys)
        bars: dict = {}  # the k-th best of each query so far, by store and block: what lies below can't come in
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = pa.Table.from_batches([batch.slice(at, BLOCK_ROWS)]).sort_by([("store", "ascending")] + [(key, "ascending") for key in keys])
                store = np.array(piece.column("store").to_pylist(), dtype=object)
                units = _rows_of(piece.column("embedding").combine_chunks())
                rows = piece.select(["store", *keys]).to_pandas()
                for name in dict.fromkeys(store.tolist()):
                    own = np.flatnonzero(store == name)
                    for number, block in enumerate(blocks):
                        ids, matrix = block.value
                        sims = np.clip(np.round(units[own] @ matrix, 9), 0.0, 1.0)
                        bar = bars.setdefault((name, number), np.full(len(ids), -1.0))
                        row, col = leading(sims, k)
                        good = sims[row, col] >= bar[col]
                        row, col = row[good], col[good]
                        if len(own) >= k:
                            np.maximum(bar, np.partition(sims, len(own) - k, axis=0)[len(own) - k], out=bar)
                        part = rows.iloc[own[row]].reset_index(drop=True)
                        part["query_id"], part["score"] = ids[col], sims[row, col]
                        best.add(part)
            release()
        result = best.result()
        if result is not None:
            result = result[["query_id", "store", *keys, "score"]]
            yield pa.RecordBatch.from_arrays([pa.array(result[f.name].tolist(), to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)

    return vectors.select("store", *keys, "embedding").mapInArrow(nearest, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, keys: list[str], limits: Limits = Limits()) -> DataFrame:
    """query_id, store, keys, score, rank: the k most similar vectors per query and store.

    `vectors` has store, keys and `embedding`; `queries` has query_id and `embedding`. The score is the cosine clamped
    to [0, 1], rounded to nine decimals; equal scores stay in key order.
    """
    queries = queries.select("query_id", "embedding")
    id_field = queries.schema["query_id"]
    send = vectors.sparkSession.sparkContext.broadcast
    blocks = [
        send((np.array([r["query_id"] for r in rows], dtype=object), _unit_rows([r["embedding"] for r in rows]).T))
        for rows in query_blocks(queries, limits.queries_per_slice, "query_id")
    ]
    found = _candidates(vectors, blocks, id_field, k, keys)
    w = Window.partitionBy("query_id", "store").orderBy(F.desc("score"), *keys)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
