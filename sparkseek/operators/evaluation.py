"""Scoring of ranked answers against gold files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

WARNING = "did not validate against the source folder"
#: Columns of an answer that evaluation hands on.
RECORDED = ("error", "verified_candidates", "needs_human_review")


def gold_ranks(ranked: DataFrame, gold: DataFrame, k: int | None = None, strict: bool = False, key: str = "query_id") -> DataFrame:
    """key, rank: position of the first candidate that is a suffix of a gold path or the other way round.

    `ranked` has key, rank, path; `gold` has key, path. With `strict` a suffix has to start at a path separator.
    """
    c = ranked.select(key, "rank", P.norm_path("path").alias("_c"))
    if k is not None:
        c = c.where(F.col("rank") <= k)
    g = gold.select(key, P.norm_path("path").alias("_g"))
    if strict:
        c, g = c.withColumn("_c", F.concat(F.lit("/"), "_c")), g.withColumn("_g", F.concat(F.lit("/"), "_g"))
    matched = c.join(g, key).where(F.endswith("_c", F.col("_g")) | F.endswith("_g", F.col("_c")))
    return matched.groupBy(key).agg(F.min("rank").alias("rank"))


def score_answers(answers: DataFrame, ranks: DataFrame, patch_ranks: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """Per answer (key, text, has_gold_diff): hit, rank, rr, produced_diff, diff_validated, patch_file_hit.

    What a run recorded besides its text stays in its row: `error`, `verified_candidates`, `needs_human_review`, as far as
    `answers` has them. A run that ended in an error has no scores.
    """
    scored = answers.join(ranks, key, "left")
    if patch_ranks is not None:
        scored = scored.join(patch_ranks.select(key, F.lit(True).alias("_patch")), key, "left")
    else:
        scored = scored.withColumn("_patch", F.lit(None).cast("boolean"))
    produced = F.contains("text", F.lit("@@"))
    recorded = [name for name in RECORDED if name in answers.columns]
    judged = F.col("error").isNull() if "error" in recorded else F.lit(True)
    scores = {
        "hit": F.col("rank").isNotNull(),
        "rank": F.col("rank"),
        "rr": F.when(F.col("rank").isNotNull(), F.lit(1.0) / F.col("rank")).otherwise(0.0),
        "produced_diff": produced,
        "diff_validated": produced & ~F.contains("text", F.lit(WARNING)),
        "patch_file_hit": F.when(F.col("has_gold_diff"), F.coalesce("_patch", F.lit(False))),
    }
    return scored.select(key, *[F.when(judged, score).alias(name) for name, score in scores.items()], *recorded)


def summarize(rows: DataFrame, error: str | None = None) -> DataFrame:
    """One row of rates over the answers without an error; rates of nothing are 0, the patch rate of nothing is null."""
    ok = F.col(error).isNull() if error else F.lit(True)
    scored = F.count_if(ok)
    n = F.greatest(scored, F.lit(1))
    rate = lambda c: F.round(F.count_if(ok & F.col(c)) / n, 3)
    return rows.agg(
        F.count("*").alias("n"),
        scored.alias("n_scored"),
        rate("hit").alias("hit_rate_at_k"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("rr"))), F.lit(0.0)) / n, 3).alias("mrr"),
        rate("produced_diff").alias("produced_diff_rate"),
        rate("diff_validated").alias("diff_validated_rate"),
        F.round(F.avg(F.when(ok, F.col("patch_file_hit").cast("double"))), 3).alias("patch_file_hit_rate"),
    )
