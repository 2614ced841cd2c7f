"""Search queries: single channels, fusion stages and the full hybrid search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import Settings
from ..operators import bm25, dense, exact, fusion
from ..plans import indexing
from ..plans.search import HybridSearch, cached_search, search_line
from ..sizes import fits, small_side
from ..sources import stores as S
from ..workspace import new_folder
from . import data as D
from .chunks import sql_windows
from .files import sql_keywords
from .registry import query

SETTINGS = replace(Settings(), retrieval=replace(Settings().retrieval, default_scope="framework"))
_R, _K, _B = SETTINGS.retrieval, SETTINGS.ranking, SETTINGS.bm25
ROOTS = SETTINGS.scope_roots()
TENANT, COPYING_TENANT = S.Tenant("oem"), S.Tenant("oem-copies")

# -- SQL building blocks ---------------------------------------------------------------------------------------------


def sql_bm25(corpus: str, queries: str, keys: str, k: int, name: str = "bm25") -> str:
    """CTEs ending in `<name>` (query_id, store, keys, score, rank): top k per query and store.

    `corpus` has store, keys and text; `queries` has query_id and query.
    """
    t = f"{name}_"
    return f"""
{t}doc AS MATERIALIZED (SELECT store, {keys}, regexp_extract_all(lower(text), '{fv.TOKEN_PATTERN}') AS tokens FROM {corpus}),
{t}len AS MATERIALIZED (SELECT store, {keys}, len(tokens) AS dl FROM {t}doc),
{t}size AS (SELECT store, count(*) AS n, avg(dl) AS avgdl FROM {t}len GROUP BY store),
{t}tf AS MATERIALIZED (SELECT store, {keys}, term, count(*) AS tf FROM (SELECT store, {keys}, unnest(tokens) AS term FROM {t}doc) GROUP BY ALL),
{t}df AS (SELECT store, term, count(*) AS df FROM {t}tf GROUP BY store, term),
{t}raw AS (SELECT store, term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM {t}df JOIN {t}size USING (store)),
{t}mean AS (SELECT store, avg(raw) AS mean FROM {t}raw GROUP BY store),
{t}idf AS MATERIALIZED (SELECT store, term, CASE WHEN raw < 0 THEN {_B.epsilon} * mean ELSE raw END AS idf FROM {t}raw JOIN {t}mean USING (store)),
{t}q AS (SELECT query_id, term, count(*) AS qtf FROM
  (SELECT query_id, unnest(regexp_extract_all(lower(query), '{fv.TOKEN_PATTERN}')) AS term FROM {queries}) GROUP BY ALL),
{t}score AS MATERIALIZED (SELECT query_id, store, {keys},
    round(sum(qtf * idf * tf * {_B.k1 + 1} / (tf + {_B.k1} * ({1 - _B.b} + {_B.b} * dl / avgdl))), 9) AS score
  FROM {t}q JOIN {t}tf USING (term) JOIN {t}idf USING (store, term) JOIN {t}len USING (store, {keys}) JOIN {t}size USING (store)
  GROUP BY ALL),
{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, store ORDER BY score DESC, {keys}) AS rank
  FROM {t}score WHERE score > 0) WHERE rank <= {k})"""


def sql_hash_vectors(relation: str, keys: str, text: str, name: str, dim: int = 64) -> str:
    """CTEs ending in `<name>` (keys, slot, w): unit-length hashing vectors, one row per used slot."""
    return f"""
{name}_tok AS (SELECT {keys}, md5(unnest(regexp_extract_all(lower({text}), '{fv.TOKEN_PATTERN}'))) AS h FROM {relation}),
{name}_slot AS MATERIALIZED (SELECT {keys}, CAST(concat('0x', substr(h, 1, 7)) AS BIGINT) % {dim} AS slot,
    sum(CASE WHEN CAST(concat('0x', substr(h, 8, 1)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v FROM {name}_tok GROUP BY ALL),
{name} AS MATERIALIZED (SELECT {keys}, slot, CAST(v AS DOUBLE) / (CASE WHEN norm = 0 THEN 1 ELSE norm END) AS w FROM
  (SELECT *, sqrt(CAST(sum(v * v) OVER (PARTITION BY {keys}) AS DOUBLE)) AS norm FROM {name}_slot))"""


_CONTENT = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"
_ORDER_STORE = "CASE store WHEN 'base' THEN 0 ELSE 1 END"


def sql_indexed() -> str:
    """CTEs `indexed` (files in scope and tier) and `chunk` (their chunks)."""
    return f"""{D.TREE_SQL},
indexed AS MATERIALIZED (SELECT * FROM tree WHERE {D.sql_under_roots('path', ROOTS)} AND
  CASE store WHEN 'base' THEN {D.sql_should_index('path', 'size_bytes', 'base')} ELSE {D.sql_should_index('path', 'size_bytes', 'customer')} END),
{sql_windows('indexed', 'store, path')},
chunk AS MATERIALIZED (SELECT store, path, idx, {_CONTENT} AS text, length({_CONTENT}) AS content_len FROM windows)"""


def sql_channels(queries: str) -> str:
    """CTEs ending in `hits`: query_id, channel, ch, store, path, idx, rank, content_len."""
    return f"""
{sql_bm25('chunk', queries, 'path, idx, content_len', _R.k_bm25)},
bm25_hits AS MATERIALIZED (SELECT query_id, 'bm25' AS channel, 2 AS ch, store, path, idx, content_len,
  row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER_STORE}, score DESC, path, idx) AS rank FROM bm25),
{sql_hash_vectors('chunk', 'store, path, idx, content_len', 'text', 'cv')},
{sql_hash_vectors(queries, 'query_id', 'query', 'qv')},
pair AS MATERIALIZED (SELECT q.query_id, c.store, c.path, c.idx, c.content_len, sum(q.w * c.w) AS s FROM qv q JOIN cv c USING (slot) GROUP BY ALL),
pair_all AS MATERIALIZED (SELECT q.query_id, c.store, c.path, c.idx, c.content_len, greatest(0.0, least(1.0, round(coalesce(s, 0.0), 9))) AS score
  FROM {queries} q CROSS JOIN chunk c LEFT JOIN pair p ON p.query_id = q.query_id AND p.store = c.store AND p.path = c.path AND p.idx = c.idx),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, store ORDER BY score DESC, path, idx) AS n FROM pair_all)
  WHERE n <= {_R.k_dense}),
dense_hits AS MATERIALIZED (SELECT query_id, 'dense' AS channel, 1 AS ch, store, path, idx, content_len,
  row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER_STORE}, score DESC, path, idx) AS rank FROM dense),
{sql_exact(queries)},
exact_hits AS (SELECT query_id, 'exact' AS channel, 3 AS ch, CAST(NULL AS VARCHAR) AS store, path, -1 AS idx, content_len, rank FROM exact),
hits AS MATERIALIZED (SELECT query_id, channel, ch, store, path, idx, content_len, rank FROM dense_hits UNION ALL
  SELECT query_id, channel, ch, store, path, idx, content_len, rank FROM bm25_hits UNION ALL
  SELECT query_id, channel, ch, store, path, idx, content_len, rank FROM exact_hits)"""


_EXACT_DIRS = f"list_has_any(string_split({D.sql_rooted('path')}, '/'), {D.sql_list(fv.EXACT_SKIPPED_DIRS)})"
_ROOT_NO = "CASE " + " ".join(f"WHEN {D.sql_under_roots('path', [r])} THEN {i}" for i, r in enumerate(ROOTS)) + " END"


def sql_exact(queries: str) -> str:
    """CTEs ending in `exact` (query_id, path, content_len, rank)."""
    return f"""
{sql_keywords(queries, 'query_id', 'query')},
searched AS MATERIALIZED (SELECT path, {_ROOT_NO} AS root_no, lower(text) AS low,
    length(text) AS content_len
  FROM tree WHERE list_contains({D.sql_list(fv.EXACT_SUFFIXES)}, {D.sql_suffix('path')}) AND NOT {_EXACT_DIRS} AND {_ROOT_NO} IS NOT NULL),
exact AS MATERIALIZED (SELECT * FROM (SELECT query_id, path, content_len, row_number() OVER (PARTITION BY query_id ORDER BY root_no, path) AS rank FROM
  (SELECT DISTINCT query_id, path, root_no, content_len FROM keywords JOIN searched ON contains(low, lower(keyword))))
  WHERE rank <= {_R.k_exact})"""


def sql_fused() -> str:
    """CTEs ending in `fused`."""
    return f"""
fused AS MATERIALIZED (SELECT query_id, path, round(sum(1.0 / ({float(_K.rrf_k)} + rank)), 12) AS score,
    string_agg(DISTINCT channel, '+' ORDER BY channel) AS source,
    CASE WHEN bool_or(coalesce(store = 'customer', false)) THEN 'customer' ELSE arg_min(coalesce(store, ''), ch * 1000 + rank) END AS store,
    arg_max(channel, content_len * 1000000 - ch * 10000 - rank) AS content_channel,
    arg_max(idx, content_len * 1000000 - ch * 10000 - rank) AS content_idx,
    arg_max(coalesce(store, ''), content_len * 1000000 - ch * 10000 - rank) AS content_store
  FROM hits GROUP BY query_id, path)"""


def sql_prior() -> str:
    low = "lower(path)"
    terms = [
        (D.sql_contains_any(low, _R.customer_path_parts), _K.prior_customer_path),
        ("store = 'customer'", _K.prior_customer_store),
        (f"list_has_any(regexp_extract_all({D.sql_stem('path')}, '{fv.IDENTIFIER_PATTERN}'), q_tokens)", _K.prior_symbol_in_path),
        (f"list_contains({D.sql_list(fv.STACK_SUFFIXES)}, {D.sql_suffix('path')})", fv.PRIOR_STACK_SUFFIX),
    ]
    for words, parts, ends, weight in fv.INTENT_PRIORS:
        terms.append((f"{D.sql_contains_any('q', words)} AND ({D.sql_contains_any(low, parts)} OR {D.sql_ends_with_any(low, ends)})", weight))
    return "round(" + " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0.0 END" for c, w in terms) + ", 6)"


def sql_pool(queries: str) -> str:
    """CTEs ending in `pool`: the candidates for the rerank."""
    return f"""
features AS MATERIALIZED (SELECT query_id, query, lower(query) AS q, regexp_extract_all(lower(query), '{fv.TOKEN_PATTERN}') AS q_tokens FROM {queries}),
normed AS (SELECT *, CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END AS base_norm FROM
  (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM fused)),
boosted AS (SELECT n.*, query, CAST({sql_prior()} AS DOUBLE) AS prior FROM normed n JOIN features USING (query_id)
  WHERE NOT {D.sql_legacy('path')} OR {D.sql_contains_any('q', fv.LEGACY_QUERY_WORDS)}),
pool AS MATERIALIZED (SELECT * FROM (SELECT query_id, query, path, store, source, content_channel, content_idx, content_store, base_norm, prior, base_norm + prior AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY round(base_norm + prior, 9) DESC, path) AS rank FROM boosted) WHERE rank <= {_K.pool})"""


def sql_search(queries: str, k: int) -> str:
    """CTEs ending in `found`: the full search."""
    a = _K.rerank_blend
    return f"""{sql_indexed()},{sql_channels(queries)},{sql_fused()},{sql_pool(queries)},
shown AS MATERIALIZED (SELECT p.*, CASE WHEN content_channel = 'exact' THEN t.text ELSE c.text END AS content
  FROM pool p LEFT JOIN tree t USING (path) LEFT JOIN chunk c ON c.store = p.content_store AND c.path = p.path AND c.idx = p.content_idx),
scored_text AS MATERIALIZED (SELECT query_id, path, CASE WHEN length(coalesce(content, '')) > 0 THEN content ELSE path END AS text FROM shown),
{sql_hash_vectors('scored_text', 'query_id, path', 'text', 'pv')},
sim AS (SELECT query_id, path, sum(q.w * p.w) AS s FROM pv p JOIN qv q USING (query_id, slot) GROUP BY ALL),
reranked AS MATERIALIZED (SELECT s.*, round(coalesce(sim.s, 0.0), 9) AS rerank_raw,
    {a} * greatest(0.0, least(1.0, (round(coalesce(sim.s, 0.0), 9) + 1.0) / 2.0)) + {1 - a} * score AS final
  FROM shown s LEFT JOIN sim USING (query_id, path)),
found AS (SELECT * EXCLUDE (rank), {D.sql_layer('path')} AS layer FROM reranked QUALIFY
  row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, path) <= {k}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(final, 9) DESC, path) AS rank FROM found)"""


BUGS_SQL = "bugs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"

# -- shared index ----------------------------------------------------------------------------------------------------


def _with_base_store(spark: SparkSession, sf_dir: str) -> S.StoreProvider:
    """The stores of one data folder with the base layer in place, which all tenants share: built once per application."""

    def build() -> S.StoreProvider:
        provider = S.StoreProvider(spark, new_folder(spark, "stores"), _R.embed_model)
        base = D.source_tree(spark, sf_dir).where("store = 'base'").select("path", "size_bytes", "text")
        indexing.build_store(base, provider.base_folder(TENANT.version), "base", SETTINGS)
        return provider

    return cached_search((spark.sparkContext.applicationId, sf_dir, "base"), build)


def _tenant_search(spark: SparkSession, sf_dir: str, tenant: S.Tenant, own: DataFrame) -> HybridSearch:
    """Search of a tenant over the shared base layer and a layer of its `own` files, and over the virtual tree: built once per application."""

    def build() -> HybridSearch:
        provider = _with_base_store(spark, sf_dir)
        indexing.build_store(own.select("path", "size_bytes", "text"), provider.customer_folder(tenant), "customer", SETTINGS)
        return HybridSearch(provider.open(tenant), D.source_tree(spark, sf_dir).select("path", "text"), SETTINGS)

    return cached_search((spark.sparkContext.applicationId, sf_dir, tenant.slug), build)


def search_over_tree(spark: SparkSession, sf_dir: str) -> HybridSearch:
    """Search over the virtual tree of one data folder: built once per application, then reused."""
    return _tenant_search(spark, sf_dir, TENANT, D.source_tree(spark, sf_dir).where("store = 'customer'"))


# -- single channels -------------------------------------------------------------------------------------------------


@query("bm25_topk", f"""WITH {BUGS_SQL}, corpus AS (SELECT 'base' AS store, doc_id, text FROM documents),
{sql_bm25('corpus', 'bugs', 'doc_id', 20)}
SELECT query_id, doc_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM bm25""")
def bm25_topk(spark, sf_dir):
    """BM25 top 20 of whole documents for every passage."""
    docs = D.documents(spark, sf_dir, "doc_id", "text").withColumn("store", F.lit("base"))
    hits = bm25.search(docs, D.bug_queries(spark, sf_dir), 20, ["doc_id"], "text")
    return hits.select("query_id", "doc_id", "rank", F.round("score", 6).alias("score"))


@query("bm25_statistics", f"""WITH {D.TREE_SQL},
doc AS (SELECT store, path, regexp_extract_all(lower(text), '{fv.TOKEN_PATTERN}') AS tokens FROM tree),
size AS (SELECT store, count(*) AS n, avg(len(tokens)) AS avgdl FROM doc GROUP BY store),
df AS (SELECT store, term, count(*) AS df FROM (SELECT store, unnest(list_distinct(tokens)) AS term FROM doc) GROUP BY ALL),
raw AS (SELECT *, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN size USING (store))
SELECT store, term, df, round(CASE WHEN raw < 0 THEN {_B.epsilon} * avg(raw) OVER (PARTITION BY store) ELSE raw END, 6) AS idf, n, round(avgdl, 6) AS avgdl
FROM raw""")
def bm25_statistics(spark, sf_dir):
    """Vocabulary of each store with document frequency and lifted idf, and the collection sizes."""
    corpus = bm25.written(bm25.counted(D.source_tree(spark, sf_dir), ["path"], "text"), "terms")
    vocabulary = bm25.written(bm25.vocabulary(corpus), "vocabulary")
    stats = bm25.written(bm25.collection_stats(corpus, vocabulary), "stats")
    return (
        bm25.with_idf(vocabulary, stats)
        .join(F.broadcast(stats.select("store", "n", "avgdl")), "store")  # one row per store
        .select("store", "term", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))
    )


@query("bm25_across_stores", f"""WITH {D.TREE_SQL}, {BUGS_SQL}, {sql_bm25('tree', 'bugs', 'path', 20)}
SELECT query_id, store, path, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY {_ORDER_STORE}, score DESC, path) AS INT) AS rank_concat,
  CAST(rank AS INT) AS rank_per_store,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {_ORDER_STORE}, path) AS INT) AS rank_global FROM bm25""")
def bm25_across_stores(spark, sf_dir):
    """Two stores with statistics of their own, ranked together in each of the three ways."""
    hits = bm25.search(D.source_tree(spark, sf_dir), D.bug_queries(spark, sf_dir), 20, ["path"], "text")
    ranked = hits
    for scope in ("concat", "per_store", "global"):
        ranked = fusion.rank_across_stores(ranked, ["path"], scope).withColumnRenamed("rank", f"rank_{scope}")
    return ranked.select(
        "query_id", "store", "path", F.round("score", 6).alias("score"), "rank_concat", "rank_per_store", "rank_global"
    )


@query("dense_topk", """
WITH slot AS (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
mean AS (SELECT label, i, avg(x) AS x FROM slot GROUP BY ALL),
probe AS (SELECT label, list(x ORDER BY i) AS v FROM mean GROUP BY label),
sim AS (SELECT p.label AS query_id, vec_id,
  greatest(0.0, least(1.0, round(list_cosine_similarity(p.v, CAST(e.embedding AS DOUBLE[])), 9))) AS score FROM probe p CROSS JOIN embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sim)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 20""")
def dense_topk(spark, sf_dir):
    """The 20 vectors nearest to the mean vector of each label."""
    vectors = D.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    slots = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    means = slots.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    width = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])  # one entry per dimension
    probes = means.groupBy("label").agg(width.alias("embedding")).withColumnRenamed("label", "query_id")
    hits = dense.top_k(vectors.withColumn("store", F.lit("base")), probes, 20, ["vec_id"])
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("exact_topk", f"""WITH {D.TREE_SQL}, {BUGS_SQL}, {sql_exact('bugs')}
SELECT query_id, path, CAST(rank AS INT) AS rank, round(1.0 / rank, 6) AS score FROM exact""")
def exact_topk(spark, sf_dir):
    """First 20 files per passage that hold one of its keywords."""
    tree = D.source_tree(spark, sf_dir).select("path", "text")
    hits = exact.top_k(tree, D.bug_queries(spark, sf_dir), _R.k_exact, ROOTS, _R.max_keywords)
    return hits.select("query_id", "path", "rank", F.round("score", 6).alias("score"))


@query("keyword_matches", f"""WITH {D.TREE_SQL}, {BUGS_SQL}, {sql_keywords('bugs', 'query_id', 'query')},
word AS (SELECT DISTINCT lower(keyword) AS keyword FROM keywords)
SELECT keyword, store, count(*) AS files FROM word JOIN tree ON contains(lower(text), keyword) GROUP BY ALL""")
def keyword_matches(spark, sf_dir):
    """Number of files per store that hold each keyword of the batch."""
    tree = D.source_tree(spark, sf_dir).select("path", "store", F.lower("text").alias("low"))
    words = exact.query_keywords(D.bug_queries(spark, sf_dir), _R.max_keywords)
    hits = exact.matches(tree, words.select(F.col("keyword").alias("pattern")).distinct(), ["store", "path"], "low")
    return hits.groupBy(F.col("pattern").alias("keyword"), "store").agg(F.count("*").alias("files"))


# -- fusion stages and full search -----------------------------------------------------------------------------------


@query("channel_hits", f"""WITH {BUGS_SQL}, {sql_indexed()}, {sql_channels('bugs')}
SELECT query_id, channel, store, path, CAST(idx AS INT) AS idx, CAST(rank AS INT) AS rank, CAST(content_len AS INT) AS content_len,
  {D.sql_layer('path')} AS layer FROM hits""")
def channel_hits(spark, sf_dir):
    """Hits of the three channels before fusion."""
    return search_over_tree(spark, sf_dir).channel_hits(D.bug_queries(spark, sf_dir))


@query("fused_ranks", f"""WITH {BUGS_SQL}, {sql_indexed()}, {sql_channels('bugs')}, {sql_fused()}
SELECT query_id, path, round(score, 9) AS score, source, nullif(store, '') AS store, {D.sql_layer('path')} AS layer, content_channel,
  CAST(content_idx AS INT) AS content_idx FROM fused""")
def fused_ranks(spark, sf_dir):
    """Reciprocal-rank fusion of the channels."""
    fused = search_over_tree(spark, sf_dir).fused(D.bug_queries(spark, sf_dir))
    return fused.drop("rrf_parts", "content_store").withColumn("score", F.round("score", 9))


@query("prior_pool", f"""WITH {BUGS_SQL}, {sql_indexed()}, {sql_channels('bugs')}, {sql_fused()}, {sql_pool('bugs')}
SELECT query_id, path, CAST(rank AS INT) AS rank, round(base_norm, 6) AS base_norm, prior, round(score, 6) AS score FROM pool""")
def prior_pool(spark, sf_dir):
    """Normalised scores with priors, legacy files dropped, cut to the rerank pool."""
    pool = search_over_tree(spark, sf_dir).pool(D.bug_queries(spark, sf_dir))
    return pool.select(
        "query_id", "path", "rank", F.round("base_norm", 6).alias("base_norm"), "prior", F.round("score", 6).alias("score")
    )


_SEARCH_COLUMNS = """query_id, CAST(rank AS INT) AS rank, path, layer, nullif(store, '') AS store, source, round(final, 6) AS score,
  round(rerank_raw, 6) AS similarity, md5(content) AS digest"""


def _search_result(hits: DataFrame) -> DataFrame:
    return hits.select(
        "query_id", "rank", "path", "layer", "store", "source", "score",
        F.round("rerank_raw", 6).alias("similarity"), F.md5("content").alias("digest"),
    )


@query("hybrid_search", f"WITH {BUGS_SQL}, {sql_search('bugs', _R.k_final)} SELECT {_SEARCH_COLUMNS} FROM ranked")
def hybrid_search(spark, sf_dir):
    """The full search: channels, fusion, priors, pool, embedding rerank, top 12."""
    return _search_result(search_over_tree(spark, sf_dir).search(D.bug_queries(spark, sf_dir)))


def _overlapping(spark: SparkSession, sf_dir: str) -> HybridSearch:
    """The search over two stores of which the second also holds its own version of every third base file."""
    tree = D.source_tree(spark, sf_dir)
    changed = F.concat("text", F.when(F.col("store") == "base", F.lit("\nlocal change")).otherwise(F.lit("")))
    own = tree.where("store = 'customer' OR doc_id % 3 = 0").withColumn("text", changed)
    return _tenant_search(spark, sf_dir, COPYING_TENANT, own)


_TWICE = sql_search("bugs", _R.k_final).replace(
    "indexed AS MATERIALIZED (SELECT * FROM tree WHERE",
    "both_stores AS (SELECT * FROM tree UNION ALL SELECT * REPLACE (text || chr(10) || 'local change' AS text, 'customer' AS store) FROM tree"
    " WHERE store = 'base' AND doc_id % 3 = 0),\nindexed AS MATERIALIZED (SELECT * FROM both_stores WHERE",
)


@query("overlapping_stores", f"WITH {BUGS_SQL}, {_TWICE} SELECT {_SEARCH_COLUMNS} FROM ranked")
def overlapping_stores(spark, sf_dir):
    """The full search where the customer's store holds changed copies of base files: one hit per path, with the right text."""
    return _search_result(_overlapping(spark, sf_dir).search(D.bug_queries(spark, sf_dir)))


@query("hybrid_search_without_model", f"""WITH {BUGS_SQL}, {sql_indexed()}, {sql_channels('bugs')}, {sql_fused()}, {sql_pool('bugs')}
SELECT query_id, path, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM pool WHERE rank <= {_R.k_final}""")
def hybrid_search_without_model(spark, sf_dir):
    """The search when no reranker is at hand: the pool cut to the top 12."""
    base = search_over_tree(spark, sf_dir)
    plain = HybridSearch(base.store, base.files, replace(SETTINGS, ranking=replace(_K, rerank_enabled=False)))
    return plain.search(D.bug_queries(spark, sf_dir)).select("query_id", "path", "rank", "score")


# Hints for the lookups: the first word of each passage.
_HINT_SQL = "hint AS (SELECT item_id AS query_id, regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]+') AS hint FROM benchmark)"


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract("text", "[A-Za-z_][A-Za-z0-9_]+", 0)
    return D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), words.alias("hint"))


def _lookup_sql(template: str, layer: str, ends) -> str:
    before, after = template.split("%s")
    return f"""WITH {_HINT_SQL}, asked AS (SELECT query_id, '{before}' || hint || '{after}' AS query FROM hint), {sql_search('asked', 12)},
marked AS (SELECT *, layer = '{layer}' OR {D.sql_ends_with_any('lower(path)', ends)} AS m FROM ranked),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM
  (SELECT *, bool_or(m) OVER (PARTITION BY query_id) AS any_m FROM marked) WHERE m OR NOT any_m)
SELECT query_id, CAST(n AS INT) AS rank, path, layer FROM chosen WHERE n <= 8"""


@query("signal_lookup", _lookup_sql(fv.SIGNAL_LOOKUP, "vss", (".yaml", ".yml", ".vss")))
def signal_lookup(spark, sf_dir):
    """Signal lookup with its layer-or-suffix filter and fallback."""
    return search_over_tree(spark, sf_dir).lookup_signal(hints(spark, sf_dir)).select("query_id", "rank", "path", "layer")


@query("interface_lookup", _lookup_sql(fv.INTERFACE_LOOKUP, "aidl", (".aidl",)))
def interface_lookup(spark, sf_dir):
    """Interface lookup with its layer-or-suffix filter and fallback."""
    return search_over_tree(spark, sf_dir).find_interface(hints(spark, sf_dir)).select("query_id", "rank", "path", "layer")


@query("symbol_lookup", f"""WITH {_HINT_SQL}, asked AS (SELECT query_id, hint AS query FROM hint), {sql_search('asked', 10)}
SELECT query_id, CAST(rank AS INT) AS rank, path, layer FROM ranked""")
def symbol_lookup(spark, sf_dir):
    """Symbol lookup: top 10."""
    return search_over_tree(spark, sf_dir).find_symbol(hints(spark, sf_dir)).select("query_id", "rank", "path", "layer")


_SNIP = "translate(substr(content, 1, {n}), chr(10), ' ')"


@query("search_lines", f"""WITH {BUGS_SQL}, {sql_search('bugs', _R.k_final)}
SELECT query_id, CAST(rank AS INT) AS rank, rank || '. [' || layer || '|' || source || '|' || printf('score=%.3f', CAST(CAST(CAST(round(final, 6) AS DECIMAL(18, 6)) AS DECIMAL(18, 3)) AS DOUBLE))
  || CASE WHEN prior <> 0 THEN printf(' prior=+%.2f', prior) ELSE '' END || printf(' ce=%.2f', CAST(CAST(CAST(rerank_raw AS DECIMAL(18, 9)) AS DECIMAL(18, 2)) AS DOUBLE)) || '] ' || path || chr(10) || '   '
  || translate(substr(content, 1, 500), chr(10), ' ') AS line FROM ranked""")
def search_lines(spark, sf_dir):
    """Search hits as the display lines of the search tool."""
    hits = search_over_tree(spark, sf_dir).search(D.bug_queries(spark, sf_dir))
    return hits.select("query_id", "rank", search_line().alias("line"))


_SEED_SQL = """talk AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS log FROM conversations GROUP BY conv_id),
bug AS (SELECT item_id AS query_id, b.text AS report, c.log FROM benchmark b LEFT JOIN talk c ON c.conv_id = b.item_id),
asked AS (SELECT query_id, report || CASE WHEN log IS NULL THEN chr(10) ELSE chr(10) || log END AS q0 FROM bug),
seeds AS (SELECT query_id, regexp_replace(q0, '^\\s+|\\s+$', '', 'g') AS query FROM asked)"""


@query("seed_search", f"WITH {_SEED_SQL}, {sql_search('seeds', _R.k_final)} SELECT query_id, CAST(rank AS INT) AS rank, path, round(final, 6) AS score FROM ranked")
def seed_search(spark, sf_dir):
    """First search of a run: report and log together (the log is a whole conversation)."""
    return search_over_tree(spark, sf_dir).seed(reported(spark, sf_dir)).select("query_id", "rank", "path", "score")


def reported(spark, sf_dir):
    """query_id, report, log; of all turns only those of reported bugs are put together."""
    bugs = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("report"))
    ids = bugs.select(F.col("query_id").alias("conv_id"))
    talk = D.table(spark, sf_dir, "conversations", "conv_id", "turn", "text").join(small_side(ids, fits(ids)), "conv_id", "left_semi")
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    logs = talk.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda t: t["text"]), "\n").alias("log"))
    return bugs.join(logs, F.col("query_id") == F.col("conv_id"), "left").select("query_id", "report", "log")


_RELOCATE_SQL = f"""asked AS (SELECT item_id AS query_id, trim(text) || ' ' || 'Car' || regexp_extract(text, '[A-Za-z]+') || 'Service '
  || 'src/' || regexp_extract(text, '[A-Za-z]+') || '.java' AS query FROM benchmark)"""


@query("relocation_search", f"WITH {_RELOCATE_SQL}, {sql_search('asked', _R.k_final)} SELECT query_id, CAST(rank AS INT) AS rank, path, round(final, 6) AS score FROM ranked")
def relocation_search(spark, sf_dir):
    """Second search led by the type and path names that objections mention; the rejected file's own name is left out."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    notes = F.format_string(
        "DISAGREE target=src/%s.java :: look at Car%sService, car%sservice or RejectedManager", word, word, word
    )
    bugs = D.table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("report"), notes.alias("notes"),
        F.lit("src/RejectedManager.java").alias("rejected_file"),
    )
    return search_over_tree(spark, sf_dir).relocate(bugs).select("query_id", "rank", "path", "score")

