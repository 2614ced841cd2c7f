"""Rank fusion, score normalisation and result-list operators.

Channel hits carry the length of their content instead of the content; the text itself is fetched for the few rows
that survive the pool cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Ranking

# Order in which channels speak when everything else is equal.
CHANNELS = ("dense", "bm25", "exact")
STORES = ("base", "customer")


def store_number(store: str = "store") -> Column:
    return F.when(F.col(store) == "base", 0).otherwise(1)


def rank_across_stores(hits: DataFrame, keys: list[str], scope: str = "concat") -> DataFrame:
    """Rank of per-store top lists within a query.

    concat: the customer list follows the whole base list; per_store: each list counts from one; global: by score.
    """
    if scope == "concat":
        w = Window.partitionBy("query_id").orderBy(store_number(), F.desc("score"), *keys)
    elif scope == "per_store":
        w = Window.partitionBy("query_id", "store").orderBy(F.desc("score"), *keys)
    elif scope == "global":
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), store_number(), *keys)
    else:
        raise ValueError(f"unknown rank scope {scope!r}")
    return hits.withColumn("rank", F.row_number().over(w))


def by_query(rows: DataFrame) -> DataFrame:
    """Rows partitioned by query, once for all per-query steps that follow.

    A query holds a bounded number of hits, so no query makes a partition large. The fixed number of partitions keeps
    small batches spread over the cores.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query_id")


def channel_number(channel: str = "channel") -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in CHANNELS]), F.col(channel))


def reciprocal_rank_fusion(hits: DataFrame, ranking: Ranking = Ranking()) -> DataFrame:
    """One row per query and path.

    `hits` of all channels have query_id, channel, store (null for the exact channel), path, idx, rank, content_len, layer.
    The score sums 1 / (k + rank) over all hits of the path. The longest content stands for the path, the earliest hit
    on a tie, and brings its layer. `rrf_parts` holds the share of each channel's last hit.
    """
    hits = by_query(hits.where(F.col("path") != ""))
    share = F.lit(1.0) / (F.lit(float(ranking.rrf_k)) + F.col("rank"))
    hits = hits.withColumn("_ch", channel_number()).withColumn("_share", share)
    if ranking.rrf_vote == "path":
        best = Window.partitionBy("query_id", "path", "channel").orderBy("rank")
        hits = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    order = F.struct(F.col("content_len"), -F.col("_ch"), -F.col("rank"))
    shown = F.max_by(F.struct("channel", "idx", "layer", "content_len", "store"), order)
    first = F.min_by(F.struct("store"), F.struct("_ch", "rank"))
    per_channel = hits.groupBy("query_id", "path", "channel", "_ch").agg(
        F.sum("_share").alias("_sum"),
        F.max_by("_share", "rank").alias("_last"),
        shown.alias("_shown"),
        F.max(order).alias("_order"),
        first.alias("_first"),
        F.max(F.col("store") == "customer").alias("_customer"),
    )
    fused = per_channel.groupBy("query_id", "path").agg(
        F.round(F.sum("_sum"), 12).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "_last")))).alias("rrf_parts"),
        F.array_join(F.array_sort(F.collect_list("channel")), "+").alias("source"),
        F.max_by("_shown", "_order").alias("_shown"),
        F.min_by("_first", "_ch").alias("_first"),
        F.max("_customer").alias("_customer"),
    )
    return fused.select(
        "query_id",
        "path",
        "score",
        "source",
        F.when(F.col("_customer"), F.lit("customer")).otherwise(F.col("_first.store")).alias("store"),
        F.col("_shown.layer").alias("layer"),
        F.col("_shown.channel").alias("content_channel"),
        F.col("_shown.idx").alias("content_idx"),
        F.col("_shown.store").alias("content_store"),
        "rrf_parts",
    )


def minmax(values: Column, window) -> Column:
    """Values scaled to [0, 1] within a window; 0.5 everywhere when they hardly differ."""
    lo, hi = F.min(values).over(window), F.max(values).over(window)
    return F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((values - lo) / (hi - lo))


def normalize_base(fused: DataFrame) -> DataFrame:
    """Adds base_norm and makes it the score."""
    scaled = minmax(F.col("score"), Window.partitionBy("query_id"))
    return fused.withColumn("base_norm", scaled).withColumn("score", F.col("base_norm"))


def best(rows: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k best rows per query with `rank`; equal scores stay in path order."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round(F.col(score), 9)), "path")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def prefer_matching(hits: DataFrame, condition: Column, k: int) -> DataFrame:
    """Per query the hits meeting a condition, or all of them when none does; at most k, ranked anew."""
    query = Window.partitionBy("query_id")
    marked = hits.withColumn("_hit", condition).withColumn("_any", F.max("_hit").over(query))
    kept = marked.where(F.col("_hit") | ~F.col("_any"))
    order = query.orderBy("rank")
    return (
        kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("_hit", "_any")
    )
