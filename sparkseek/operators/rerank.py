"""Reranking of a fused pool: pair scorer, embedding blend, or plain cut."""

from __future__ import annotations

from typing import Callable, Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as X
from ..functions import vectors as V
from .fusion import best

# A scorer takes (query text, "path\ncontent") columns and gives a raw relevance column, best as an Arrow function.
PairScorer = Callable[[Column, Column], Column]


class ScorerLoader(Protocol):
    def __call__(self, model: str) -> PairScorer: ...


def choose_scorer(models, loader: ScorerLoader | None) -> tuple[str, PairScorer] | None:
    """The first model of the list the loader can provide, with its name; none when no loader or no model works."""
    if loader is None:
        return None
    for name in dict.fromkeys(m for m in models if m):
        try:
            return name, loader(name)
        except Exception:
            continue
    return None


def blend(pool: DataFrame, raw: Column, normed: Column, k: int, weight: float) -> DataFrame:
    """score = weight x normed + (1 - weight) x score, then the k best."""
    rescored = (
        pool.withColumn("rerank_raw", raw)
        .withColumn("rerank_norm", normed)
        .withColumn("score", F.lit(weight) * F.col("rerank_norm") + F.lit(1 - weight) * F.col("score"))
    )
    return best(rescored.drop("rank"), k)


def by_pairs(pool: DataFrame, scorer: PairScorer, k: int, settings: Settings = Settings()) -> DataFrame:
    """Rerank with a pair scorer; pool has query, path, content, score."""
    document = F.concat(F.col("path"), F.lit("\n"), X.cut(F.coalesce("content", F.lit("")), settings.retrieval.rerank_content_chars))
    raw = scorer(F.col("query"), document).cast("double")
    return blend(pool, raw, V.sigmoid(F.col("rerank_raw")), k, settings.ranking.rerank_blend)


def by_embedding(pool: DataFrame, embed, k: int, settings: Settings = Settings()) -> DataFrame:
    """Rerank with the cosine of query_vector and content embedding, mapped from [-1, 1] to [0, 1]."""
    content = F.when(F.coalesce(F.length("content"), F.lit(0)) > 0, F.col("content")).otherwise(F.col("path"))
    embedded = pool.withColumn("_dv", embed(X.cut(content, settings.retrieval.rerank_content_chars)))
    similarity = F.round(V.cosine("query_vector", "_dv"), 9)
    ranked = blend(
        embedded, similarity, V.clamp((F.col("rerank_raw") + 1.0) / 2.0), k, settings.ranking.rerank_blend
    )
    return ranked.drop("query_vector", "_dv")


def cut(pool: DataFrame, k: int) -> DataFrame:
    """No model at hand: the k best of the pool as they are."""
    return best(
        pool.drop("rank").withColumn("rerank_raw", F.lit(None).cast("double")).withColumn("rerank_norm", F.lit(None).cast("double")), k
    )
