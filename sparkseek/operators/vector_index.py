"""Approximate nearest neighbours: vectors in lists around centroids, of which a query looks into the nearest ones.

The centroids are fitted on a bounded sample (the vectors whose key has the smallest hash); every vector is put into the
list of its nearest centroid, and the index is written with a partition per list, so a search reads the probed lists
only. Recall grows with `probes`; with all lists probed the result is that of the exact search.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Limits
from .dense import _unit_rows
from .topk import RunningBest, leading, query_blocks


def fit(vectors: DataFrame, keys: list[str], lists: int = 64, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit-length centroids, fitted on at most `sample` vectors by spherical k-means."""
    rows = vectors.select("embedding").orderBy(F.xxhash64(*keys), *keys).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    units = _unit_rows([r["embedding"] for r in rows])
    centroids = units[np.linspace(0, len(units) - 1, min(lists, len(units))).astype(int)]
    for _ in range(rounds):
        nearest = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        filled = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = np.where(filled[:, None], _unit_rows(sums), centroids)
    return centroids


def build(vectors: DataFrame, centroids: np.ndarray, path: str) -> None:
    """Write all vectors (store, keys, embedding) with the number of their list."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def assign(batches):
        for batch in batches:
            batch["list_no"] = (_unit_rows(batch["embedding"]) @ shared.value.T).argmax(axis=1) if len(batch) else pd.Series(dtype=int)
            yield batch

    schema = T.StructType([*vectors.schema.fields, T.StructField("list_no", T.IntegerType())])
    # A list that holds most vectors still goes to several tasks.
    vectors.mapInPandas(assign, schema).repartition("list_no", F.pmod(F.xxhash64("embedding"), F.lit(8))).write.partitionBy("list_no").parquet(path)


def top_k(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int, keys: list[str], probes: int = 8,
          limits: Limits = Limits()) -> DataFrame:
    """query_id, store, keys, score, rank: the k most similar vectors among the `probes` nearest lists of each query."""
    queries = queries.select("query_id", "embedding")
    id_field = queries.schema["query_id"]
    send = index.sparkSession.sparkContext.broadcast
    blocks: list[Broadcast] = []
    probed: set[int] = set()
    for rows in query_blocks(queries, limits.queries_per_slice, "query_id"):
        units = _unit_rows([r["embedding"] for r in rows])
        near = np.argsort(-(units @ centroids.T), axis=1)[:, :probes]
        asked = {int(no): np.flatnonzero((near == no).any(axis=1)) for no in np.unique(near)}
        probed |= asked.keys()
        ids = np.array([r["query_id"] for r in rows], dtype=object)
        blocks.append(send({no: (ids[which], units[which].T) for no, which in asked.items()}))
    schema = T.StructType([id_field] + [index.schema[c] for c in ["store", *keys]] + [T.StructField("score", T.DoubleType())])

    def nearest(batches):
        best = RunningBest(k, ["query_id", "store"], keys)
        for batch in batches:
            for (store, no), rows in batch.groupby(["store", "list_no"], sort=False):
                rows = rows.sort_values(keys)
                units = _unit_rows(rows["embedding"])
                for block in blocks:
                    if no not in block.value:
                        continue
                    ids, matrix = block.value[no]
                    sims = np.clip(np.round(units @ matrix, 9), 0.0, 1.0)
                    row, col = leading(sims, k)
                    part = rows[["store", *keys]].iloc[row].reset_index(drop=True)
                    part["query_id"], part["score"] = ids[col], sims[row, col]
                    best.add(part)
        result = best.result()
        if result is not None:
            yield result[["query_id", "store", *keys, "score"]]

    wanted = index.where(F.col("list_no").isin(sorted(probed)))  # prunes partitions
    found = wanted.select("store", *keys, "embedding", "list_no").mapInPandas(nearest, schema)
    w = Window.partitionBy("query_id", "store").orderBy(F.desc("score"), *keys)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
