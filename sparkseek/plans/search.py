"""Hybrid search: three channels, fusion, priors, pool cut and rerank, for a batch of queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..config import Settings
from ..functions import paths as P
from ..functions import text as X
from ..functions import vectors as V
from ..operators import bm25, dense, exact, fusion, postings, priors, rerank
from ..sizes import fits, small_side
from ..sources.files import TRUNCATED
from ..sources.stores import CompositeStore
from ..workspace import written

KEYS = ["path", "idx", "content_len"]
HIT_COLUMNS = ["query_id", "channel", "store", "path", "idx", "rank", "content_len"]


class HybridSearch:
    """Search over one opened store and, for the exact channel, the source files (path, text).

    Every part may be missing: without files the exact channel is off, without `embed` the dense channel and the
    embedding rerank are off, without `loader` no pair scorer is used.
    """

    def __init__(self, store: CompositeStore | None, files: DataFrame | None = None, settings: Settings = Settings(),
                 embed="default", loader: rerank.ScorerLoader | None = None):
        self.store, self.files, self.settings = store, files, settings
        self.embed = V.hashing_embedder(settings.retrieval.embed_dim) if embed == "default" else embed
        r = settings.ranking
        self.scorer = rerank.choose_scorer(r.rerank_models, loader) if r.rerank_enabled else None

    def index_roots(self) -> list[str]:
        """Roots of the exact channel: what was indexed, else the scope preset."""
        return (self.store.index_roots() if self.store else None) or list(self.settings.scope_roots())

    # -- channels ------------------------------------------------------------------------------------------------

    def dense_hits(self, queries: DataFrame) -> DataFrame:
        """query_id, store, path, idx, content_len, score, rank."""
        embedded = queries.withColumn("embedding", self.embed(F.col("query")))
        hits = dense.top_k(
            self.store.table("chunks"), embedded, self.settings.retrieval.k_dense, KEYS, self.settings.limits
        )
        return fusion.rank_across_stores(hits, KEYS, self.settings.ranking.rank_scope)

    def bm25_hits(self, queries: DataFrame) -> DataFrame:
        """query_id, store, path, idx, content_len, score, rank."""
        s = self.settings
        stats = self.store.table("stats")
        idf = bm25.with_idf(self.store.table("vocabulary"), stats, s.bm25)
        weights = bm25.term_weights(idf, queries, fits(queries, s.limits))
        hits = postings.top_k(
            self.store.table("postings"), self.store.table("documents"), weights, stats, s.retrieval.k_bm25, KEYS, s.bm25, s.limits
        )
        return fusion.rank_across_stores(hits, KEYS, s.ranking.rank_scope)

    def exact_hits(self, queries: DataFrame) -> DataFrame:
        """query_id, path, content_len, score, rank."""
        r = self.settings.retrieval
        full = F.length("text")
        most = r.exact_content_chars
        shown = full if most is None else F.when(full > most, F.lit(most + len(TRUNCATED))).otherwise(full)
        return exact.top_k(
            self.files.withColumn("content_len", shown), queries, r.k_exact, self.index_roots(), r.max_keywords,
            limits=self.settings.limits, carry=["content_len"],
        )

    def channel_hits(self, queries: DataFrame) -> DataFrame:
        """The hits of every available channel in one frame."""
        found = []
        if self.store is not None and self.embed is not None:
            found.append(self.dense_hits(queries).withColumn("channel", F.lit("dense")))
        if self.store is not None:
            found.append(self.bm25_hits(queries).withColumn("channel", F.lit("bm25")))
        if self.files is not None:
            hits = self.exact_hits(queries).withColumn("channel", F.lit("exact"))
            found.append(hits.withColumn("store", F.lit(None).cast("string")).withColumn("idx", F.lit(-1)))
        if not found:
            raise ValueError("neither a store nor source files to search")
        hits = reduce(DataFrame.unionByName, [f.select(*HIT_COLUMNS) for f in found])
        return hits.withColumn("layer", P.guess_layer("path"))

    # -- stages --------------------------------------------------------------------------------------------------

    def fused(self, queries: DataFrame) -> DataFrame:
        return fusion.reciprocal_rank_fusion(self.channel_hits(queries), self.settings.ranking)

    def pool(self, queries: DataFrame) -> DataFrame:
        """The candidates that go into the rerank, without their content."""
        scored = priors.apply_priors(fusion.normalize_base(self.fused(queries)), queries, self.settings)
        return fusion.best(scored, self.settings.ranking.pool)

    def with_content(self, pool: DataFrame) -> DataFrame:
        """Fetch the content each pooled row stands for, from its own store; only rows of the pool are read into the join."""
        small = fits(pool.select("query_id", "path"), self.settings.limits)
        from_file = F.col("content_channel") == "exact"
        wanted = pool.select(F.col("content_store").alias("store"), "path", F.col("content_idx").alias("idx"), from_file.alias("_x")).distinct()
        texts = None
        if self.store is not None:
            chunks = self.store.table("chunks").select("store", "path", "idx", "content")
            texts = chunks.join(small_side(wanted.where("not _x").drop("_x"), small), ["store", "path", "idx"])
        if self.files is not None:
            head = X.cut("text", self.settings.retrieval.exact_content_chars, TRUNCATED)
            heads = self.files.join(small_side(wanted.where("_x").select("path"), small), "path").select(
                F.lit("").alias("store"), "path", F.lit(-1).alias("idx"), head.alias("content")
            )
            texts = heads if texts is None else texts.unionByName(heads)
        found = texts.withColumnsRenamed({"idx": "content_idx", "store": "_store"})
        return pool.withColumn("_store", F.coalesce("content_store", F.lit(""))).join(found, ["_store", "path", "content_idx"], "left").drop("_store")

    def search(self, queries: DataFrame, top_k: int | None = None) -> DataFrame:
        """Ranked hits for `queries` (query_id, query)."""
        k = top_k or self.settings.retrieval.k_final
        asked = queries.select("query_id", "query")
        use_embedding = self.scorer is None and self.embed is not None and self.settings.ranking.rerank_enabled
        if use_embedding:
            asked = asked.withColumn("query_vector", self.embed(F.col("query")))
        pool = written(self.pool(queries), "search-pool")
        hits = fusion.by_query(self.with_content(pool)).join(asked, "query_id")
        if self.scorer is not None:
            ranked = rerank.by_pairs(hits, self.scorer[1], k, self.settings)
        elif use_embedding:
            ranked = rerank.by_embedding(hits, self.embed, k, self.settings)
        else:
            ranked = rerank.cut(hits, k)
        return ranked.select(
            "query_id", "rank", "path", "layer", "store", "source", F.round("score", 6).alias("score"),
            F.round("base_norm", 6).alias("base_norm"), "prior", "rerank_raw", "rerank_norm", "rrf_parts", "content",
        )

    # -- lookups -------------------------------------------------------------------------------------------------

    def _lookup(self, hints: DataFrame, template: str, layer: str, endings, searched: int, k: int) -> DataFrame:
        queries = hints.select("query_id", F.format_string(template, F.col("hint")).alias("query"))
        matching = (F.col("layer") == layer) | P.ends_with_any(F.lower("path"), endings)
        return fusion.prefer_matching(self.search(queries, searched), matching, k)

    def lookup_signal(self, hints: DataFrame, searched: int = 12, k: int = 8) -> DataFrame:
        """Signal definitions for `hints` (query_id, hint)."""
        return self._lookup(hints, fv.SIGNAL_LOOKUP, "vss", (".yaml", ".yml", ".vss"), searched, k)

    def find_interface(self, hints: DataFrame, searched: int = 12, k: int = 8) -> DataFrame:
        """Interface definitions for `hints` (query_id, hint)."""
        return self._lookup(hints, fv.INTERFACE_LOOKUP, "aidl", (".aidl",), searched, k)

    def find_symbol(self, hints: DataFrame, k: int = 10) -> DataFrame:
        """Places of a symbol for `hints` (query_id, hint)."""
        return self.search(hints.select("query_id", F.col("hint").alias("query")), k)

    def seed(self, bugs: DataFrame) -> DataFrame:
        """First search for `bugs` (query_id, report, log): all hits, each with its display line."""
        joined = F.concat_ws("\n", F.trim(F.coalesce("report", F.lit(""))), F.trim(F.coalesce("log", F.lit(""))))
        hits = self.search(bugs.select("query_id", X.strip(joined).alias("query")).where("query <> ''"))
        return hits.withColumn("line", seed_line())

    def relocate(self, bugs: DataFrame) -> DataFrame:
        """Second search for `bugs` (query_id, report, notes, rejected_file) led by names in the objections."""
        hinted = bugs.withColumn("_hints", X.relocation_hints("notes", "rejected_file")).where(F.size("_hints") > 0)
        text = F.concat_ws(" ", F.trim("report"), F.array_join("_hints", " "))
        return self.search(hinted.select("query_id", X.strip(text).alias("query")))


def seed_line() -> Column:
    return F.format_string(
        "%d. [%s|%s|score=%.3f] %s\n   %s", F.col("rank"), F.col("layer"), F.col("source"), F.col("score"), F.col("path"),
        X.snippet("content", 400),
    )


def search_line() -> Column:
    """Display line of a search hit with the reasons for its score."""
    why = F.concat(
        F.format_string("score=%.3f", F.col("score")),
        F.when(F.col("prior") != 0, F.format_string(" prior=+%.2f", F.col("prior"))).otherwise(F.lit("")),
        F.when(F.col("rerank_raw").isNotNull(), F.format_string(" ce=%.2f", F.col("rerank_raw"))).otherwise(F.lit("")),
    )
    return F.format_string(
        "%d. [%s|%s|%s] %s\n   %s", F.col("rank"), F.col("layer"), F.col("source"), why, F.col("path"), X.snippet("content", 500)
    )


_CACHE: dict = {}


def cached_search(key, build) -> HybridSearch:
    """One search object per key, such as (application, root, tenant)."""
    if key not in _CACHE:
        _CACHE[key] = build()
    return _CACHE[key]
