"""Path, filter, token and read queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import Settings
from ..functions import paths as P
from ..functions import text as X
from ..operators import bm25
from ..sources.files import TRUNCATED, read_sources
from . import data as D
from .registry import query

_SETTINGS = Settings()
_FRAMEWORK = _SETTINGS.scope_roots("framework")


@query("path_layers", f"WITH {D.TREE_SQL} SELECT doc_id, path, {D.sql_layer('path')} AS layer FROM tree")
def path_layers(spark, sf_dir):
    """Layer tag of every file."""
    return D.source_tree(spark, sf_dir).select("doc_id", "path", P.guess_layer("path").alias("layer"))


@query("layer_counts", f"WITH {D.TREE_SQL} SELECT {D.sql_layer('path')} AS layer, store, count(*) AS files, "
                       "CAST(sum(size_bytes) AS BIGINT) AS bytes FROM tree GROUP BY 1, 2")
def layer_counts(spark, sf_dir):
    """Files and bytes per layer and store."""
    return (
        D.source_tree(spark, sf_dir)
        .groupBy(P.guess_layer("path").alias("layer"), "store")
        .agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    )


@query("index_filter", f"WITH {D.TREE_SQL} SELECT doc_id, path, {D.sql_should_index('path', 'size_bytes', 'base')} AS base, "
                       f"{D.sql_should_index('path', 'size_bytes', 'customer')} AS customer FROM tree")
def index_filter(spark, sf_dir):
    """Both tiers of the index filter for every file."""
    return D.source_tree(spark, sf_dir).select(
        "doc_id",
        "path",
        P.should_index("path", "size_bytes", "base").alias("base"),
        P.should_index("path", "size_bytes", "customer").alias("customer"),
    )


@query(
    "legacy_and_policy_paths",
    f"WITH {D.TREE_SQL} SELECT doc_id, {D.sql_legacy('path')} AS legacy, "
    f"({D.sql_ends_with_any(D.sql_rooted('path'), ('.te', '.cil'))} OR {D.sql_contains_any(D.sql_rooted('path'), fv.POLICY_MARKERS)}) AS policy "
    "FROM tree",
)
def legacy_and_policy_paths(spark, sf_dir):
    """Legacy-interface and access-policy predicates."""
    return D.source_tree(spark, sf_dir).select(
        "doc_id", P.is_legacy_path("path").alias("legacy"), P.is_policy_path("path").alias("policy")
    )


_ROOT_CASES = " ".join(f"WHEN {D.sql_under_roots('path', [r])} THEN {i}" for i, r in enumerate(_FRAMEWORK))


@query("scope_roots", f"WITH {D.TREE_SQL} SELECT doc_id, {D.sql_under_roots('path', _SETTINGS.scope_roots('automotive'))} AS automotive, "
                      f"{D.sql_under_roots('path', _FRAMEWORK)} AS framework, CASE {_ROOT_CASES} END AS root_no FROM tree")
def scope_roots(spark, sf_dir):
    """Scope presets: which files they cover, and through which root."""
    return D.source_tree(spark, sf_dir).select(
        "doc_id",
        P.under_roots("path", _SETTINGS.scope_roots("automotive")).alias("automotive"),
        P.under_roots("path", _FRAMEWORK).alias("framework"),
        P.root_number("path", _FRAMEWORK).alias("root_no"),
    )


@query("page_paths", r"""
SELECT page_id, lower(regexp_replace(regexp_replace(url, '^\s+|\s+$', '', 'g'), '^[./]+', '')) AS norm,
""" + f"{D.sql_layer('url')} AS layer, {D.sql_suffix('url')} AS suffix, {D.sql_stem('url')} AS stem FROM pages")
def page_paths(spark, sf_dir):
    """Path functions on page addresses."""
    return D.table(spark, sf_dir, "pages", "page_id", "url").select(
        "page_id",
        P.norm_path("url").alias("norm"),
        P.guess_layer("url").alias("layer"),
        P.suffix("url").alias("suffix"),
        P.stem("url").alias("stem"),
    )


_TOKENS = f"regexp_extract_all(lower(text), '{fv.TOKEN_PATTERN}')"


@query("code_tokens", f"""
SELECT doc_id, len({_TOKENS}) AS tokens, len(list_distinct({_TOKENS})) AS distinct_tokens,
  md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents""")
def code_tokens(spark, sf_dir):
    """Token list of every document, as counts and a digest of the list in order."""
    tokens = D.documents(spark, sf_dir, "doc_id", "text").select("doc_id", X.code_tokens("text").alias("t"))
    return tokens.select(
        "doc_id",
        F.size("t").alias("tokens"),
        F.size(F.array_distinct("t")).alias("distinct_tokens"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@query("token_postings", f"""
SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY 1, 2""")
def token_postings(spark, sf_dir):
    """Term counts per document."""
    docs = D.documents(spark, sf_dir, "doc_id", "text").withColumn("store", F.lit("base"))
    return (
        bm25.counted(docs, ["doc_id"], "text")
        .select("doc_id", F.explode("terms").alias("p"))
        .select("doc_id", "p.term", F.col("p.tf").cast("bigint").alias("tf"))
    )


def sql_keywords(relation: str, key: str, text: str) -> str:
    """CTEs ending in `keywords` (key, pos, keyword): the ordered keyword list of each text, exploded.

    Word bounds are ASCII-only here, so letters outside ASCII are turned into a word character first.
    """
    stop = D.sql_list(fv.KEYWORD_STOP_WORDS)
    strong = " UNION ALL ".join(
        f"SELECT {key}, {i} AS part, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM "
        f"(SELECT {key}, regexp_extract_all(regexp_replace({text}, '[^\\x00-\\x7f]', '{'x' if i == 0 else '_'}', 'g'), '{p}', 0) AS l FROM {relation})"
        for i, p in enumerate((fv.CONST_ID_PATTERN, fv.INTERFACE_ID_PATTERN, fv.TYPE_ID_PATTERN, fv.DOTTED_ID_PATTERN))
    )
    return f"""
kw_strong AS ({strong} UNION ALL
  SELECT {key}, 4, regexp_replace(unnest(l), '\\.[^.]*$', ''), generate_subscripts(l, 1)
  FROM (SELECT {key}, regexp_extract_all({text}, '{fv.FRAME_PATTERN}', 1) AS l FROM {relation})),
kw_words AS (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS pos
  FROM (SELECT {key}, regexp_extract_all({text}, '{fv.WORD_PATTERN}', 0) AS l FROM {relation})),
kw_domain AS (SELECT {key}, 5 AS part, w, pos FROM kw_words
  WHERE {D.sql_contains_any('lower(w)', fv.KEYWORD_DOMAIN_PARTS)}),
kw_lead AS (SELECT DISTINCT {key} FROM (SELECT {key} FROM kw_strong UNION ALL SELECT {key} FROM kw_domain)),
kw_plain AS (SELECT {key}, 6 AS part, w, row_number() OVER (PARTITION BY {key} ORDER BY pos) AS pos FROM kw_words
  WHERE NOT list_contains({stop}, lower(w))),
kw_all AS (SELECT * FROM kw_strong UNION ALL SELECT * FROM kw_domain UNION ALL
  SELECT p.* FROM kw_plain p LEFT JOIN kw_lead l USING ({key}) WHERE pos <= CASE WHEN l.{key} IS NULL THEN 10 ELSE 4 END),
keywords AS MATERIALIZED (SELECT {key}, w AS keyword, row_number() OVER (PARTITION BY {key} ORDER BY min(part * 1000000 + pos)) AS pos
  FROM kw_all WHERE w <> '' GROUP BY {key}, w)"""


@query("code_keywords", f"WITH {sql_keywords('documents', 'doc_id', 'text')} SELECT doc_id, CAST(pos AS INT) AS pos, keyword FROM keywords")
def code_keywords(spark, sf_dir):
    """Ordered search keywords of every document."""
    return (
        D.documents(spark, sf_dir, "doc_id", "text")
        .select("doc_id", F.posexplode(X.code_keywords("text")).alias("pos", "keyword"))
        .select("doc_id", (F.col("pos") + 1).alias("pos"), "keyword")
    )


@query("source_reads", f"""WITH {D.TREE_SQL}, asked AS (
  SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN path WHEN 1 THEN './' || path WHEN 2 THEN '../' || path ELSE path || '.orig' END AS path
  FROM conversations JOIN tree ON doc_id = conv_id),
read AS (SELECT a.conv_id, a.turn, a.path,
    CASE WHEN starts_with(a.path, '../') THEN '[refused: ' || a.path || ' is outside the source root]'
      WHEN t.text IS NULL THEN '[error reading ' || a.path || ': no such file]'
      WHEN length(t.text) > 2000 THEN substr(t.text, 1, 2000) || chr(10) || chr(10) || '... [truncated] ...' ELSE t.text END AS content
  FROM asked a LEFT JOIN tree t ON t.path = CASE WHEN starts_with(a.path, './') THEN substr(a.path, 3) ELSE a.path END)
SELECT conv_id, turn, path, length(content) AS chars, md5(content) AS digest FROM read""")
def source_reads(spark, sf_dir):
    """Guarded reads: plain, dotted, escaping and missing paths."""
    tree = D.source_tree(spark, sf_dir).select("doc_id", "path", "text")
    turns = D.table(spark, sf_dir, "conversations", "conv_id", "turn")
    kind = F.col("turn") % 4
    asked = turns.join(tree.select("doc_id", "path"), F.col("conv_id") == F.col("doc_id")).select(
        "conv_id",
        "turn",
        F.when(kind == 0, F.col("path"))
        .when(kind == 1, F.concat(F.lit("./"), "path"))
        .when(kind == 2, F.concat(F.lit("../"), "path"))
        .otherwise(F.concat("path", F.lit(".orig")))
        .alias("path"),
    )
    read = read_sources(asked, tree, "/src", 2000)
    return read.select("conv_id", "turn", "path", F.length("content").alias("chars"), F.md5("content").alias("digest"))


assert TRUNCATED == "\n\n... [truncated] ..."
