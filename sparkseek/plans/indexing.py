"""Building and refreshing tenant stores."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import paths as P
from ..functions import vectors as V
from ..operators import bm25
from ..operators import postings as inverted
from ..operators.chunking import chunk_files
from ..sources import changes as C
from ..sources import stores as S

CHUNK_COLUMNS = ("path", "idx", "chunk_id", "content", "content_len", "ext", "layer", "dl", "terms", "embedding")


def chunk_rows(files: DataFrame, settings: Settings = Settings(), embed=None, ast_ranges=None) -> DataFrame:
    """Chunk table rows of files (path, text): content, term counts and embedding side by side."""
    r = settings.retrieval
    dim = r.embed_dim if embed is None else None
    added = f"dl int, terms {bm25.TERMS}" + (", embedding array<float>" if embed is None else "")
    chunks = chunk_files(files.select("path", "text"), r.chunk_size, r.chunk_overlap, ast_ranges=ast_ranges, added=added, describe=_described(dim))
    if embed is not None:
        chunks = chunks.withColumn("embedding", embed(F.col("content")).cast("array<float>"))
    return chunks.withColumn("content_len", F.length("content")).select(*CHUNK_COLUMNS)


def _described(dim: int | None):
    """Term counts of contents, and their hashing vectors if a width is given."""

    def run(contents: list[str]) -> list[pa.Array]:
        counts = bm25.Counts.of(contents)
        if dim is None:
            return counts.columns()
        vectors = V.term_vectors(counts.terms, counts.tfs, counts.row, len(contents), dim).astype(np.float32).ravel()
        return [*counts.columns(), pa.ListArray.from_arrays(pa.array(np.arange(len(contents) + 1) * dim, pa.int32()), pa.array(vectors))]

    return run


def _write_store(spark: SparkSession, folder: str, chunks: DataFrame, files: DataFrame, manifest: dict) -> S.Manifest:
    """Write a complete new data folder, then point the manifest at it."""
    data = f"v-{uuid.uuid4().hex}"
    at = f"{folder}/{data}"
    inverted.placed(chunks, ["path", "idx", "content_len"]).write.parquet(f"{at}/chunks")
    documents = spark.read.parquet(f"{at}/chunks").withColumn("store", F.lit("s"))
    inverted.write(inverted.postings(documents).drop("store"), f"{at}/postings")
    postings = spark.read.parquet(f"{at}/postings").withColumn("store", F.lit("s"))
    inverted.vocabulary(postings).drop("store").write.parquet(f"{at}/vocabulary")
    vocabulary = spark.read.parquet(f"{at}/vocabulary").withColumn("store", F.lit("s"))
    stats = bm25.collection_stats(documents, vocabulary)
    stats.drop("store").coalesce(1).write.parquet(f"{at}/stats")
    files.write.parquet(f"{at}/files")
    result = S.Manifest(count=documents.count(), data=data, **manifest)
    S.write_manifest(spark, folder, result)
    return result


def build_store(
    files: DataFrame,
    folder: str,
    mode: str,
    settings: Settings = Settings(),
    scope: str | None = None,
    git_sha: str | None = None,
    embed=None,
    ast_ranges=None,
) -> S.Manifest:
    """Full build from files (path, size_bytes, text)."""
    spark = files.sparkSession
    roots = settings.scope_roots(scope)
    kept = files.where(P.should_index("path", "size_bytes", mode, F.col("text")))
    scoped = kept.where(P.under_roots("path", roots))
    if "." not in roots and scoped.select("path").isEmpty():
        scoped = kept
    return _write_store(
        spark,
        folder,
        chunk_rows(scoped, settings, embed, ast_ranges),
        C.snapshot(scoped),
        {
            "embed_model": settings.retrieval.embed_model,
            "git_sha": git_sha,
            "index_roots": list(roots),
            "scope": scope or settings.retrieval.default_scope,
        },
    )


def refreshed_chunks(old: DataFrame, changed_files: DataFrame, touched: DataFrame, settings: Settings = Settings(),
                     embed=None, ast_ranges=None) -> DataFrame:
    """Chunk table after a change: rows of touched paths go, rows of the changed files come."""
    kept = old.select(*CHUNK_COLUMNS).join(touched.select("path").distinct(), "path", "left_anti")
    return kept.select(*CHUNK_COLUMNS).unionByName(chunk_rows(changed_files, settings, embed, ast_ranges))


def refresh_store(
    files: DataFrame,
    folder: str,
    mode: str,
    settings: Settings = Settings(),
    changes: DataFrame | None = None,
    git_sha: str | None = None,
    scope: str | None = None,
    embed=None,
    ast_ranges=None,
) -> S.Manifest:
    """Incremental build: only changed files are cut and embedded again.

    `files` is the present state of the tree. Without `changes` (path, status), they are found by comparing content
    digests with those kept in the store. A store that cannot be refreshed is built anew. A file that fell out of the
    filters or the scope, or was renamed, loses its old chunks.
    """
    spark = files.sparkSession
    before = S.read_manifest(spark, folder)
    if before is None or before.data is None:
        return build_store(files, folder, mode, settings, scope, git_sha, embed, ast_ranges)
    roots = tuple(before.index_roots or settings.scope_roots(before.scope or scope))
    data = f"{folder}/{before.data}"
    eligible = files.where(P.should_index("path", "size_bytes", mode, F.col("text")) & P.under_roots("path", roots))
    snapshot = C.snapshot(eligible)
    if changes is None:
        changes = C.snapshot_changes(spark.read.parquet(f"{data}/files"), snapshot)
    updated = changes.where("status <> 'D'").select("path").distinct()
    chunks = refreshed_chunks(
        spark.read.parquet(f"{data}/chunks"), eligible.join(updated, "path", "left_semi"), changes, settings, embed, ast_ranges
    )
    return _write_store(
        spark,
        folder,
        chunks,
        snapshot,
        {
            "embed_model": settings.retrieval.embed_model,
            "git_sha": git_sha,
            "index_roots": before.index_roots,
            "scope": before.scope,
        },
    )
