"""Okapi BM25 over an inverted view of the corpus, for many queries at once.

Scale notes
* Term counts of a document are taken in one Arrow pass over the texts, in pieces of bounded size, so counting needs no
  shuffle.
* The vocabulary comes from the sizes of the postings (`postings.py`), one row per term and slice of documents.
* Queries are scored against the postings of their terms, in blocks of bounded size; neither all terms of a document nor
  (query, document) pairs are handed on.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..batches import pieces, release
from ..config import Bm25, Limits
from ..functions import text as X
from ..functions.paths import bound
from ..sizes import fits, small_side
from ..workspace import written
from . import postings


def term_counts(tokens: Column) -> Column:
    """array<struct<term, tf>> of one token list, from the runs of its sorted order."""

    def run_lengths(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (s[i - 1] != F.get(s, i - 2)))
        return bound(
            starts,
            lambda st: F.transform(
                st,
                lambda p, j: F.struct(
                    s[p - 1].alias("term"), (F.coalesce(F.get(st, j + 1), F.size(s) + 1) - p).alias("tf")
                ),
            ),
        )

    return bound(F.sort_array(tokens), lambda s: F.when(F.size(s) > 0, run_lengths(s)))


TERMS = "array<struct<term: string, tf: int>>"
# A token (see TOKEN_PATTERN) is a run of these bytes without its leading digits and dots, of two at least.
_RUNS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789_." else 32 for c in range(256))
_NO_START = "0123456789."


@dataclass(frozen=True)
class Counts:
    """Counted terms of some texts, text after text, each text's in order."""

    dl: pa.Array
    row: np.ndarray  # the text of each counted term
    terms: pa.DictionaryArray
    tfs: np.ndarray

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Counts:
        runs, sizes, known = [], [], []
        for text in texts:
            own = (text or "").lower().encode("utf-8", "replace").translate(_RUNS).split()
            runs += own
            sizes.append(len(own))
            known.append(text is not None)
        tokens = pc.ascii_ltrim(pa.array(runs, pa.string()), characters=_NO_START)
        kept = pc.greater_equal(pc.binary_length(tokens), 2)
        coded = tokens.filter(kept).dictionary_encode()
        row = np.repeat(np.arange(len(sizes)), sizes)[kept.to_numpy(zero_copy_only=False)]
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        width = max(len(order), 1)
        pairs, tfs = np.unique(row * width + rank[coded.indices.to_numpy()], return_counts=True)
        terms = pa.DictionaryArray.from_arrays(pa.array(pairs % width, pa.int32()), coded.dictionary.take(pa.array(order)))
        dl = pa.array(np.bincount(row, minlength=len(sizes)).astype(np.int32), mask=~np.array(known, dtype=bool))
        return cls(dl, pairs // width, terms, tfs.astype(np.int32))

    def columns(self) -> list[pa.Array]:
        """dl int, terms; a text without a token has no list."""
        pairs = pa.StructArray.from_arrays([self.terms.dictionary_decode(), pa.array(self.tfs)], names=["term", "tf"])
        size = np.bincount(self.row, minlength=len(self.dl))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
        return [self.dl, pa.ListArray.from_arrays(ends, pairs, mask=pa.array(size == 0))]


def counted(docs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """store, keys, dl, terms: each document with its length and term counts."""
    carried = ["store", *keys]
    schema = T.StructType([docs.schema[name] for name in carried] + T.StructType.fromDDL(f"dl int, terms {TERMS}").fields)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "_text"):
                counts = Counts.of(t.as_py() for t in piece.column("_text"))
                yield pa.RecordBatch.from_arrays([*piece.select(carried).columns, *counts.columns()], names=schema.names)
            release()

    return docs.select(*carried, F.col(text).alias("_text")).mapInArrow(run, schema)


def vocabulary(docs: DataFrame) -> DataFrame:
    """store, term, df of counted documents."""
    return docs.select("store", F.explode("terms.term").alias("term")).groupBy("store", "term").agg(F.count("*").alias("df"))


def _raw_idf(df: Column, n: Column) -> Column:
    return F.log(n - df + 0.5) - F.log(df + 0.5)


def collection_stats(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """store, n, avgdl, terms, mean_idf: one row per store. Documents without a token count too."""
    sizes = docs.groupBy("store").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    means = (
        vocab.join(F.broadcast(sizes), "store")  # one row per store
        .groupBy("store")
        .agg(F.count("*").alias("terms"), F.avg(_raw_idf(F.col("df"), F.col("n"))).alias("mean_idf"))
    )
    return sizes.join(means, "store", "left")


def with_idf(vocab: DataFrame, stats: DataFrame, params: Bm25 = Bm25()) -> DataFrame:
    """store, term, df, idf; a negative value is lifted to epsilon times the store's mean."""
    raw = _raw_idf(F.col("df"), F.col("n"))
    return vocab.join(F.broadcast(stats), "store").select(  # one row per store
        "store", "term", "df", F.when(raw < 0, F.lit(params.epsilon) * F.col("mean_idf")).otherwise(raw).alias("idf")
    )


def query_terms(queries: DataFrame, query: str = "query") -> DataFrame:
    """query_id, term, qtf: repeated query words count repeatedly."""
    return (
        queries.select("query_id", F.explode(X.code_tokens(query)).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count("*").alias("qtf"))
    )


def term_weights(idf: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """store, term, query_id, w: what one unit of term gain adds to a query's score."""
    return idf.join(small_side(query_terms(queries), small), "term").select(
        "store", "term", "query_id", (F.col("qtf") * F.col("idf")).alias("w")
    )


def search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    keys: list[str],
    text: str,
    params: Bm25 = Bm25(),
    limits: Limits = Limits(),
) -> DataFrame:
    """BM25 top-k straight from texts: `docs` has store, keys and text; `queries` has query_id and query."""
    small = fits(queries, limits)
    corpus = written(postings.placed(counted(docs, keys, text), ["store", *keys]), "bm25-terms")
    vocab = written(vocabulary(corpus), "bm25-vocabulary")
    stats = written(collection_stats(corpus, vocab), "bm25-stats")
    # For one batch, the part of an index that its terms need.
    index = postings.postings(corpus, small_side(query_terms(queries).select("term").distinct(), small))
    weights = term_weights(with_idf(vocab, stats, params), queries, small)
    return postings.top_k(index if small else written(index, "bm25-postings"), corpus, weights, stats, k, keys, params, limits)
