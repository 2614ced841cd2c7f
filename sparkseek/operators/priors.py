"""Additive path priors and the legacy-path drop."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import Settings
from ..functions import paths as P
from ..functions import text as X


def query_features(queries: DataFrame, query: str = "query") -> DataFrame:
    """query_id, _q_tokens (distinct tokens), _q_legacy, and one flag per intent: everything asked of the query text.

    Taken once per query, before the join with its hits.
    """
    low = F.lower(query)
    intents = [P.contains_any(low, words).alias(f"_intent{i}") for i, (words, *_) in enumerate(fv.INTENT_PRIORS)]
    return queries.select(
        "query_id", F.array_distinct(X.code_tokens(query)).alias("_q_tokens"), X.mentions_legacy(query).alias("_q_legacy"), *intents
    )


def prior(settings: Settings = Settings()) -> Column:
    """Sum of the priors that apply to a hit (path, store) and the features of its query."""
    r = settings.ranking
    ids = X.find_all(P.stem("path"), fv.IDENTIFIER_PATTERN)
    if r.symbol_prior_casefold:
        ids = F.transform(ids, lambda i: F.lower(i))

    def total(path: Column) -> Column:
        terms = [
            (P.contains_any(path, settings.retrieval.customer_path_parts), r.prior_customer_path),
            (F.coalesce(F.col("store") == "customer", F.lit(False)), r.prior_customer_store),
        ]
        for i, (_, parts, endings, weight) in enumerate(fv.INTENT_PRIORS):
            terms.append((F.col(f"_intent{i}") & (P.contains_any(path, parts) | P.ends_with_any(path, endings)), weight))
        terms.append((F.arrays_overlap(ids, F.col("_q_tokens")), r.prior_symbol_in_path))
        terms.append((P.suffix("path").isin(*fv.STACK_SUFFIXES), fv.PRIOR_STACK_SUFFIX))
        return reduce(add, [F.when(cond, F.lit(weight)).otherwise(F.lit(0.0)) for cond, weight in terms])

    return P.bound(P.lowered("path"), total)


def apply_priors(fused: DataFrame, queries: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds `prior` to the score and drops legacy hits of queries that do not ask for them."""
    features = query_features(queries)
    scored = fused.join(features, "query_id").withColumn("prior", F.round(prior(settings), 6))
    legacy = (F.col("layer") == "hidl_legacy") | P.is_legacy_path("path")
    return (
        scored.where(~legacy | F.col("_q_legacy"))
        .withColumn("score", F.col("score") + F.col("prior"))
        .select(*fused.columns, "prior")
    )
