"""Evaluation queries: passages are bugs, documents that hold a passage word for word are its gold files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, exact
from ..operators import evaluation as E
from ..workspace import written
from . import data as D
from .registry import query
from .retrieval import BUGS_SQL, sql_bm25

_GOLD_SQL = f"""{D.TREE_SQL}, {BUGS_SQL},
gold AS (SELECT query_id, path FROM bugs JOIN tree ON contains(text, query))"""
_RANKED_SQL = f"""{sql_bm25('tree', 'bugs', 'path', 5, 'top')},
ranked AS (SELECT query_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM top)"""


def gold_files(spark, sf_dir):
    tree = D.source_tree(spark, sf_dir).select("path", "text")
    bugs = D.bug_queries(spark, sf_dir)
    hits = exact.matches(tree, bugs.select(F.col("query").alias("pattern")).distinct(), ["path"], "text")
    return hits.join(bugs, F.col("pattern") == F.col("query")).select("query_id", "path")


def ranked_files(spark, sf_dir):
    tree = D.source_tree(spark, sf_dir).withColumn("store", F.lit("base"))
    return bm25.search(tree, D.bug_queries(spark, sf_dir), 5, ["path"], "text").select("query_id", "path", "rank")


_ONE_STORE = _RANKED_SQL.replace("FROM tree),", "FROM (SELECT 'base' AS store, path, text FROM tree)),", 1)


@query("gold_files", f"WITH {_GOLD_SQL} SELECT query_id, path FROM gold")
def gold(spark, sf_dir):
    """Documents holding each passage word for word, found in one pass over the texts."""
    return gold_files(spark, sf_dir)


_RANK_SQL = """matched AS (SELECT r.query_id, min(rank) AS rank FROM ranked r JOIN gold g ON r.query_id = g.query_id
  AND (ends_with(lower(r.path), lower(g.path)) OR ends_with(lower(g.path), lower(r.path))) GROUP BY r.query_id)"""


@query("answer_scores", f"""WITH {_GOLD_SQL}, {_ONE_STORE}, {_RANK_SQL}
SELECT query_id, rank IS NOT NULL AS hit, CAST(rank AS INT) AS rank, coalesce(round(1.0 / rank, 6), 0.0) AS rr,
  query_id % 3 <> 0 AS produced_diff, query_id % 3 = 1 AS diff_validated,
  CASE WHEN query_id % 2 = 0 THEN rank IS NOT NULL END AS patch_file_hit FROM bugs LEFT JOIN matched USING (query_id)""")
def answer_scores(spark, sf_dir):
    """Score of every passage's answer: ranked files from BM25, with a diff in two of three answers."""
    return _scores(spark, sf_dir).withColumn("rr", F.round("rr", 6))


def _scores(spark, sf_dir):
    bugs = D.bug_queries(spark, sf_dir)
    ranks = written(E.gold_ranks(ranked_files(spark, sf_dir), gold_files(spark, sf_dir), 5), "gold-ranks")
    kind = F.col("query_id") % 3
    text = F.when(kind == 0, "no diff").when(kind == 1, "@@ -1 +1 @@").otherwise(f"@@ -1 +1 @@ {E.WARNING}")
    answers = bugs.select("query_id", text.alias("text"), (F.col("query_id") % 2 == 0).alias("has_gold_diff"))
    return E.score_answers(answers, ranks, ranks)


@query("evaluation_summary", f"""WITH {_GOLD_SQL}, {_ONE_STORE}, {_RANK_SQL},
s AS (SELECT query_id, rank FROM bugs LEFT JOIN matched USING (query_id))
SELECT count(*) AS n, count(*) AS n_scored, round(count(rank) / count(*)::DOUBLE, 3) AS hit_rate_at_k, round(sum(coalesce(1.0 / rank, 0)) / count(*), 3) AS mrr,
  round(count(*) FILTER (query_id % 3 <> 0) / count(*)::DOUBLE, 3) AS produced_diff_rate, round(count(*) FILTER (query_id % 3 = 1) / count(*)::DOUBLE, 3) AS diff_validated_rate,
  round(avg(CASE WHEN query_id % 2 = 0 THEN CAST(rank IS NOT NULL AS INT) END), 3) AS patch_file_hit_rate FROM s""")
def evaluation_summary(spark, sf_dir):
    """Hit rate at 5, mean reciprocal rank and diff rates over all passages, with and without gold."""
    return E.summarize(_scores(spark, sf_dir))


@query("ranked_answer_paths", f"""WITH {D.TREE_SQL}, a AS (SELECT doc_id, path FROM tree)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN path || ',other/b.kt' ELSE 'see/' || path || ',x/y.h' END AS paths,
  CASE WHEN doc_id % 2 = 0 THEN '' ELSE path END AS targets FROM a""")
def ranked_answer_paths(spark, sf_dir):
    """Ranked paths and diff targets mined from answers: a numbered list, or loose paths and a diff."""
    path = F.col("path")
    answer = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("## Files\n1. "), path, F.lit(" [vhal] why\n2. no-slash.java\n 3.  other/b.kt\nalso c/d.cc\n")),
    ).otherwise(F.concat(F.lit("look at see/"), path, F.lit(" and x/y.h, not see/"), path, F.lit("\n+++ b/"), path, F.lit("\n")))
    rows = D.source_tree(spark, sf_dir).select("doc_id", path, answer.alias("answer"))
    mined = X.ranked_paths("answer")
    own = F.concat(F.lit("b/"), path)
    return rows.select(
        "doc_id",
        F.array_join(F.filter(mined, lambda p: p != own), ",").alias("paths"),
        F.array_join(X.diff_targets("answer"), ",").alias("targets"),
    )
