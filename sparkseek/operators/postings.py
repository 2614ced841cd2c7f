"""An inverted index for BM25: postings by term, read for the asked terms only.

Layout. Documents are numbered where they lie, in the order of their keys within a task, and up to 1,024 neighbours are a
slice: numbering shuffles nothing. A row of the index is one term in one slice: the documents with it, how often, and how long they are, with the largest count
and the shortest length beside. So a term of most documents is one bounded row per slice, never one long list, and each row
has a bound for any score it can give. Neighbours lie in one task, which lists a slice's terms by itself; where tasks share a
slice, or its lists are long, a term has several rows there, each of other documents. On disk rows lie in folders by a hash of the term, sorted by term.

Search. The terms of a block of queries, of bounded size, select folders and rows; a task takes its slices one after the other,
keeps the best k per query and store, and leaves out every query whose bound in a slice, summed over its terms, stays below
the k-th best it has. Only k rows per query, store and task are shuffled. Blocks of queries are answered one by one, so that
one block is in memory at a time; each reads what its terms need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..batches import release
from ..config import Bm25, Limits
from ..sizes import fits, small_side
from ..workspace import new_folder, written
from .topk import leading, query_blocks

#: Documents in a slice at most, as a power of two.
SLICE_BITS = 10
#: Folders that terms are dealt into.
BUCKETS = 32

#: Queries whose scores of a slice are in memory at a time.
SCORED_QUERIES = 1024

#: Counted terms of neighbouring documents that a task lists at a time, about.
SEGMENT_TERMS = 500_000

LISTS = ("docs", "tfs", "dls")


def placed(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The documents with _slice and _doc, their place in the index. Numbers hold once only, so write the frame before it is read twice."""
    place = docs.sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    doc = F.col("_at").bitwiseAND(F.lit((1 << SLICE_BITS) - 1)).cast("int")
    return place.withColumns({"_slice": F.shiftright("_at", SLICE_BITS), "_doc": doc}).drop("_at")


ROWS = "store string, _slice long, term string, n int, most int, least int, docs array<int>, tfs array<int>, dls array<int>"


_NAMES = [column.split()[0] for column in ROWS.split(", ")]


def _lists(segment: pa.Table) -> pa.RecordBatch:
    """The rows of a slice, or of a part of it; documents come in order."""
    segment = segment.combine_chunks()
    lists = segment.column("terms").chunk(0)
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    entries = lists.flatten()
    coded = entries.field("term").dictionary_encode()
    order = np.argsort(coded.indices.to_numpy(), kind="stable")
    code = coded.indices.to_numpy()[order]
    starts = np.flatnonzero(np.diff(code, prepend=-1))
    tf = entries.field("tf").to_numpy()[order]
    doc, dl = (np.repeat(segment.column(name).to_numpy(), size)[order] for name in ("_doc", "dl"))
    ends = np.append(starts, len(code)).astype(np.int32)
    columns = [
        pa.array([segment.column("store")[0].as_py()] * len(starts), pa.string()), pa.array(np.full(len(starts), segment.column("_slice")[0].as_py())),
        coded.dictionary.take(pa.array(code[starts])), pa.array(np.diff(ends)),
        pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(dl, starts)),
        *(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32))) for values in (doc, tf, dl)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of neighbouring documents, slice by slice, of at most about SEGMENT_TERMS entries at a time."""
    held: list[pa.Table] = []
    entries = 0

    def flush():
        nonlocal entries
        if entries:
            yield _lists(pa.concat_tables(held))
        held.clear()
        entries = 0

    last = None
    for batch in batches:
        frame = pa.Table.from_batches([batch])
        store, number = frame.column("store").to_pylist(), frame.column("_slice").to_pylist()
        size = pc.fill_null(pc.list_value_length(frame.column("terms")), 0).to_pylist()
        start = 0
        for row in range(len(store)):
            if (store[row], number[row]) != last or entries > SEGMENT_TERMS:
                if row > start:
                    held.append(frame.slice(start, row - start))
                yield from flush()
                start, last = row, (store[row], number[row])
            entries += size[row]
        if len(store) > start:
            held.append(frame.slice(start))
        release()
    yield from flush()


def postings(documents: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """store, bucket, term, _slice, n, most, least, docs, tfs, dls of placed documents; with `asked` (term) of those terms only."""
    rows = documents.select("store", "_slice", "_doc", "dl", "terms").mapInArrow(_sliced, ROWS)
    if asked is not None:
        rows = rows.join(asked, "term", "left_semi")
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("bucket")
    return rows.select("store", bucket, "term", "_slice", "n", "most", "least", *LISTS)


def write(rows: DataFrame, path: str) -> None:
    """The index, a folder per bucket, sorted by term so that readers skip what they don't ask for."""
    rows.repartition("bucket").sortWithinPartitions("bucket", "term", "_slice").write.partitionBy("bucket").parquet(path)


def vocabulary(rows: DataFrame) -> DataFrame:
    """store, term, df from the sizes of the postings; the lists aren't read."""
    return rows.groupBy("store", "term").agg(F.sum("n").alias("df"))


class _Queries:
    """What a block of queries asks of one store: for each term the queries and weights."""

    def __init__(self, rows: list):
        self.ids = sorted({r["query_id"] for r in rows})
        number = {query: i for i, query in enumerate(self.ids)}
        self.terms: dict[str, tuple[list[int], list[float]]] = {}
        for r in rows:
            queries, weights = self.terms.setdefault(r["term"], ([], []))
            queries.append(number[r["query_id"]])
            weights.append(r["w"])
        self.terms = {term: (np.array(q), np.array(w)) for term, (q, w) in self.terms.items()}


class _Best:
    """The best k documents of each query of a store so far, and those that equal the last of them.

    Within a slice numbers follow the keys, so at most k of equal scores stay of each; which of several slices' come
    first, the final ranking tells.
    """

    def __init__(self, n_queries: int, k: int):
        self.k = k
        self.bar = np.zeros(n_queries)
        self.held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros((0, 2), dtype=np.int64))] * n_queries

    def add(self, queries: np.ndarray, scores: np.ndarray, number: int) -> None:
        """Scores of a slice: a row per document, a column for each of the queries."""
        row, column = leading(scores, self.k)
        found = scores[row, column]
        good = (found > 0) & (found >= self.bar[queries[column]])
        order = np.argsort(column[good], kind="stable")
        row, column, found = row[good][order], column[good][order], found[good][order]
        cuts = np.flatnonzero(np.diff(column, prepend=-1, append=-1)) if len(column) else np.zeros(0, dtype=np.int64)
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            q = queries[column[start]]
            score, place = self.held[q]
            score = np.concatenate([score, found[start:end]])
            place = np.concatenate([place, np.column_stack([np.full(end - start, number), row[start:end]])])
            if len(score) >= self.k:
                self.bar[q] = np.partition(score, len(score) - self.k)[len(score) - self.k]
                stays = score >= self.bar[q]
                score, place = score[stays], place[stays]
            self.held[q] = (score, place)


def _gain(tf, dl, mean: float, params: Bm25):
    return tf * (params.k1 + 1) / (tf + params.k1 * ((1 - params.b) + params.b * dl / mean))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """The rows of one slice after the other; batches come sorted by store and slice."""
    held: list[pa.Table] = []
    for batch in batches:
        frame = pa.Table.from_batches([batch])
        store, number = frame.column("store").to_pylist(), frame.column("_slice").to_numpy()
        cuts = [i for i in range(1, len(store)) if store[i] != store[i - 1] or number[i] != number[i - 1]]
        for start, end in zip([0, *cuts], [*cuts, len(store)], strict=True):
            if held and (held[0].column("store")[0].as_py(), held[0].column("_slice")[0].as_py()) != (store[start], number[start]):
                yield held[0].column("store")[0].as_py(), held[0].column("_slice")[0].as_py(), pa.concat_tables(held)
                held = []
            if end > start:
                held.append(frame.slice(start, end - start))
    if held:
        yield held[0].column("store")[0].as_py(), held[0].column("_slice")[0].as_py(), pa.concat_tables(held)


def _scan(block: Broadcast, means: dict[str, float], k: int, params: Bm25, query_type: pa.DataType):
    """Best k of each query and store among the slices of a task."""

    def run(batches):
        asked: dict[str, _Queries] = block.value
        best = {store: _Best(len(queries.ids), k) for store, queries in asked.items()}
        for store, number, frame in _slices(batches):
            queries, mean = asked.get(store), means.get(store)
            if queries is None or not mean:
                continue
            known = [queries.terms.get(term) for term in frame.column("term").to_pylist()]
            most, least = (frame.column(name).to_numpy().astype(np.float64) for name in ("most", "least"))
            top = _gain(most, least, mean, params)
            bound = np.zeros(len(queries.ids))
            for row, entry in enumerate(known):
                if entry is not None:
                    # A negative weight can't lift a score.
                    bound[entry[0]] += np.maximum(entry[1], 0) * top[row]
            # Scores are rounded, so a bound counts from a little above.
            open_ = np.flatnonzero((bound > 0) & (bound + 1e-8 >= best[store].bar))
            if not len(open_):
                continue
            docs, tfs, dls = (frame.column(name).combine_chunks() for name in LISTS)
            cuts = docs.offsets.to_numpy()
            doc, gain = docs.flatten().to_numpy(), _gain(tfs.flatten().to_numpy().astype(np.float64), dls.flatten().to_numpy().astype(np.float64), mean, params)
            cuts = cuts - cuts[0]
            for at in range(0, len(open_), SCORED_QUERIES):
                part = open_[at : at + SCORED_QUERIES]
                column = np.full(len(queries.ids), -1)
                column[part] = np.arange(len(part))
                scores = np.zeros((int(doc.max()) + 1, len(part)))
                for row, entry in enumerate(known):
                    if entry is None:
                        continue
                    wanted = column[entry[0]]
                    use = wanted >= 0
                    if use.any():
                        own = slice(cuts[row], cuts[row + 1])
                        scores[np.ix_(doc[own], wanted[use])] += np.outer(gain[own], entry[1][use])
                best[store].add(part, np.round(scores, 9), number)
        for store, found in best.items():
            size = [len(score) for score, _ in found.held]
            if sum(size):
                places = np.concatenate([place for _, place in found.held])
                ids = [query for query, n in zip(asked[store].ids, size, strict=True) for _ in range(n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, query_type), pa.array([store] * len(ids), pa.string()), pa.array(places[:, 0]),
                    pa.array(places[:, 1].astype(np.int32)), pa.array(np.concatenate([score for score, _ in found.held])),
                ], names=["query_id", "store", "_slice", "_doc", "score"])

    return run


def top_k(index: DataFrame, documents: DataFrame, weights: DataFrame, stats: DataFrame, k: int, keys: list[str],
          params: Bm25 = Bm25(), limits: Limits = Limits()) -> DataFrame:
    """query_id, store, keys, score, rank: best k documents per query and store with a positive score.

    `weights` has store, term, query_id, w; `documents` the keys of _slice and _doc. Scores have nine decimals; equal scores
    stay in key order.
    """
    spark = index.sparkSession
    id_field = weights.schema["query_id"]
    means = {r["store"]: r["avgdl"] for r in stats.select("store", "avgdl").collect()}  # one row per store
    schema = T.StructType([id_field, *T.StructType.fromDDL("store string, _slice long, _doc int, score double").fields])
    asked_schema = T.StructType.fromDDL("store string, bucket int, term string")

    def answered(rows: list) -> DataFrame:
        """The best of every task for one block of queries."""
        by_store: dict[str, list] = {}
        for r in rows:
            by_store.setdefault(r["store"], []).append(r)
        block = spark.sparkContext.broadcast({store: _Queries(own) for store, own in by_store.items()})
        asked = spark.createDataFrame(sorted({(r["store"], r["bucket"], r["term"]) for r in rows}), asked_schema)
        buckets = sorted({r["bucket"] for r in rows})  # at most BUCKETS
        lists = index.where(F.col("bucket").isin(buckets)).join(F.broadcast(asked), ["store", "bucket", "term"]).select("store", "_slice", "term", "most", "least", *LISTS)
        lists = lists.repartition("store", "_slice").sortWithinPartitions("store", "_slice")
        return lists.mapInArrow(_scan(block, means, k, params, to_arrow_type(id_field.dataType)), schema)

    weights = weights.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    first = weights.limit(limits.weights_per_block + 1).collect()
    if len(first) <= limits.weights_per_block:
        best = answered(first)
    else:
        weights = written(weights, "bm25-weights")
        found = new_folder(spark, "bm25-best")
        for rows in query_blocks(weights, limits.weights_per_block, "query_id"):
            answered(rows).write.mode("append").parquet(found)
        best = spark.read.schema(schema).parquet(found)
    level = Window.partitionBy("query_id", "store").orderBy(F.desc("score"))
    best = best.withColumn("_n", F.rank().over(level)).where(F.col("_n") <= k).drop("_n")  # equals of the last stay
    if not fits(documents.select("_slice"), limits):
        # The few found are sent to the many documents, which aren't shuffled for their keys.
        best = written(best, "bm25-found")
        best = small_side(best, limits=limits)
    hits = documents.select("store", "_slice", "_doc", *keys).join(best, ["store", "_slice", "_doc"])
    order = Window.partitionBy("query_id", "store").orderBy(F.desc("score"), *keys)
    return hits.select("query_id", "store", *keys, "score", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
