"""Ranked lexical search: the best documents for each query, by Block-Max MaxScore over compressed postings.

Index. Documents are taken in shards of bounded text size. A shard holds, for each of its terms, the documents with the
term and how often, in blocks of up to 128 that are delta coded in bytes of seven bits. A block says, uncompressed, which
documents it spans, the largest number of occurrences and the length of the shortest document: a bound for any score in it
whatever the corpus's mean length will be. Written as a table; shards are added without touching others.

Search. The terms of a round of queries, of bounded number, get their document counts from all shards, and so their weights.
Each shard then answers every query of the round on its own. Its lists are put in order of their bounds; as long as
the bounds of the first ones add up to less than the k-th best score so far, no document can make it with those alone:
they are not essential. Documents come from the essential lists only. What the block maxima of the other lists could add decides
whether a candidate goes on, before any of those blocks is decompressed; then list by list, strongest first, the blocks
that hold candidates are read and candidates drop out. The k best of each shard are merged.

Defined results: null and empty texts have no terms and match nothing; a null doc_id ranks behind all others of its score;
rows that share a doc_id are documents of their own; every row of queries is a query of its own, whatever its item_id;
a query without terms, or without a match, gives no rows; extra columns are ignored; empty tables give no rows. Texts
are read whole, documents are never dropped before their bound says so.
"""

from __future__ import annotations

import uuid
from array import array
from collections import Counter
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .arrow import pieces
from .common import new_folder, written

#: Bytes of text in a shard.
SHARD_BYTES = 16 << 20
#: Postings in a block.
BLOCK = 128
#: (query, term) pairs that are sent to the shards at a time.
ROUND_TERMS = 50_000
#: Tasks that the shards are dealt to at most.
MOST_TASKS = 20_000
#: Documents that are looked at together; the bar rises from one such range to the next.
RANGE = 1 << 13

#: A block of a term, or, without term, the documents of a shard: n with terms, total number of terms.
ANSWERS = "query long, score long, doc_id long"
INDEX = "shard long, term string, block int, n int, first int, last int, most int, least int, total long, packed binary"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLDED).split() if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of 32 bits or less as bytes of seven bits, the last of a number with the eighth bit clear; and where each starts."""
    width = 1 + sum((values >= 1 << bits).astype(np.int64) for bits in (7, 14, 21, 28))
    start = np.concatenate([[0], np.cumsum(width)]).astype(np.int64)
    out = np.zeros(start[-1], dtype=np.uint8)
    for k in range(5):
        has = width > k
        more = (width[has] > k + 1).astype(np.int64) << 7
        out[start[:-1][has] + k] = (values[has] >> (7 * k)) & 127 | more
    return out, start


def unpacked(data: bytes) -> np.ndarray:
    octets = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    end = np.flatnonzero(octets < 128)
    if len(end) == len(octets):
        return octets
    start = np.concatenate([[0], end[:-1] + 1])
    number = np.repeat(np.arange(len(end)), end - start + 1)
    shift = 7 * (np.arange(len(octets)) - start[number])
    out = np.zeros(len(end), dtype=np.int64)
    np.add.at(out, number, (octets & 127) << shift)
    return out


class _Shard:
    """Collects documents; rows() gives what the index holds of them."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.terms, self.times, self.kinds = array("i"), array("i"), array("i")
        self.ids: list[int | None] = []
        self.lengths = array("q")
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        counts = Counter(terms_of(text))
        number = self.number
        self.terms.extend([number.setdefault(term, len(number)) for term in counts])
        self.times.extend(counts.values())
        self.kinds.append(len(counts))
        self.lengths.append(counts.total())
        self.ids.append(doc_id)
        self.bytes += len(text) if text else 0

    def rows(self, shard: int) -> pa.RecordBatch:
        lengths = np.array(self.lengths, dtype=np.int64)
        document = np.repeat(np.arange(len(lengths)), np.array(self.kinds))
        term, times = np.array(self.terms, dtype=np.int64), np.array(self.times, dtype=np.int64)
        order = np.argsort(term, kind="stable")
        term, times, document = term[order], times[order], document[order]
        place = np.arange(len(term))
        new = np.ones(len(term), dtype=bool)
        new[1:] = term[1:] != term[:-1]
        of_term = place - np.maximum.accumulate(np.where(new, place, 0))
        start = np.flatnonzero(of_term % BLOCK == 0)
        end = np.append(start, len(term))[1:]
        # Each block: the steps from document to document, then the numbers of occurrences.
        step = np.zeros(len(term), dtype=np.int64)
        step[1:] = document[1:] - document[:-1]
        step[start] = 0
        size = end - start
        base = np.repeat(2 * start, size) + place - np.repeat(start, size)
        both = np.zeros(2 * len(term), dtype=np.int64)
        both[base], both[base + np.repeat(size, size)] = step, times
        data, at = packed(both)
        offsets = np.append(at[2 * start], len(data)).astype(np.int32)
        blocks = pa.BinaryArray.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])
        names = np.array([one.decode() for one in self.number], dtype=object)[term[start]] if len(start) else []
        known = np.array([one is not None for one in self.ids])
        ids = np.array([one or 0 for one in self.ids], dtype=np.int64)
        head = np.stack([ids, known.astype(np.int64), lengths]).tobytes()
        most, least = (np.maximum.reduceat(times, start), np.minimum.reduceat(lengths[document], start)) if len(start) else ([], [])
        columns = {
            "term": pa.array([None, *names], pa.string()), "block": pa.array([0, *(of_term[start] // BLOCK)], pa.int32()),
            "n": pa.array([int((lengths > 0).sum()), *size], pa.int32()), "first": pa.array([0, *document[start]], pa.int32()),
            "last": pa.array([0, *document[end - 1]], pa.int32()), "most": pa.array([0, *most], pa.int32()),
            "least": pa.array([0, *np.minimum(least, (1 << 31) - 1)], pa.int32()),
            "total": pa.array([int(lengths.sum()), *[None] * len(start)], pa.int64()),
            "packed": pa.chunked_array([pa.array([head], pa.binary()), blocks]).combine_chunks(),
        }
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard] * (1 + len(start)), pa.int64()), **columns})


def index_rows(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of documents (doc_id, text). Shards are numbered by task, so write it before it is read twice."""

    def run(batches):
        task, count, shard = TaskContext.get().partitionId(), 0, _Shard()
        for batch in batches:
            for piece in pieces(batch, "text", 1 << 20):
                for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist(), strict=True):
                    shard.add(doc_id, text)
                    if shard.bytes >= shard_bytes:
                        yield shard.rows((task << 32) + count)
                        count, shard = count + 1, _Shard()
        if shard.ids:
            yield shard.rows((task << 32) + count)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX)


def impact(times, length, n_documents: int, n_terms: int):
    """What an occurrence count in a document of some length is worth, in whole numbers; arrays or single numbers."""
    return (1_000_000_000 * times) // (1000 * times + 12 * (75 + (25 * length * n_documents) // n_terms))


class _List:
    """The postings of one term in one shard; blocks are decompressed when they are asked for."""

    def __init__(self, rows: dict[str, np.ndarray], data: list[bytes], norms: tuple[np.ndarray, int, int]):
        self.first, self.last, self.n, self.data, self.norms = rows["first"], rows["last"], rows["n"], data, norms
        self.bound = impact(rows["most"].astype(np.int64), rows["least"].astype(np.int64), norms[1], norms[2])
        self.read = np.zeros(len(data), dtype=bool)
        self.documents: list[np.ndarray | None] = [None] * len(data)
        self.values: list[np.ndarray | None] = [None] * len(data)

    def block_of(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block whose span may hold each document, and whether it does."""
        block = np.minimum(np.searchsorted(self.last, documents), len(self.last) - 1)
        return block, (self.first[block] <= documents) & (documents <= self.last[block])

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and their impacts in some blocks, ascending."""
        fresh = blocks[~self.read[blocks]]
        if len(fresh):
            both = unpacked(b"".join([self.data[k] for k in fresh.tolist()]))
            cuts = np.concatenate([[0], np.cumsum(2 * self.n[fresh])])
            lengths, n_documents, n_terms = self.norms
            for k, start, n in zip(fresh.tolist(), cuts[:-1].tolist(), self.n[fresh].tolist(), strict=True):
                own = np.cumsum(both[start : start + n]) + self.first[k]
                self.documents[k] = own
                self.values[k] = impact(both[start + n : start + 2 * n], lengths[own], n_documents, n_terms)
            self.read[fresh] = True
        if len(blocks) == 1:
            return self.documents[blocks[0]], self.values[blocks[0]]
        return np.concatenate([self.documents[k] for k in blocks.tolist()]), np.concatenate([self.values[k] for k in blocks.tolist()])


def _within(one: _List, low: int, high: int) -> np.ndarray:
    """Numbers of the blocks that reach into a range of documents."""
    return np.arange(np.searchsorted(one.last, low), np.searchsorted(one.first, high))


def best_of_shard(lists: list[tuple[_List, int]], ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best, higher scores first, then smaller ids (sort keys of the documents); lists with their weights."""
    lists = sorted(lists, key=lambda one: int(one[0].bound.max()) * one[1])
    bounds = np.cumsum([int(one.bound.max()) * weight for one, weight in lists])
    best_score, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    bar = 1
    for low in range(0, len(ids), RANGE):
        high = min(low + RANGE, len(ids))
        # Which lists can't lift a document over the bar, all together.
        essential = int(np.searchsorted(bounds, bar))
        score, seen = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=bool)
        scored, at = [], len(lists)
        while at > essential:
            # From the strongest list on, until the bar makes the others inessential.
            at -= 1
            one, weight = lists[at]
            blocks = _within(one, low, high)
            if not len(blocks):
                continue
            documents, values = one.postings(blocks)
            inside = (documents >= low) & (documents < high)
            documents, values = documents[inside] - low, values[inside]
            score[documents] += weight * values
            seen[documents] = True
            # A document's score so far is no more than its score, so the k-th of those is a bar already.
            known = np.concatenate([best_score, score[seen]])
            if len(known) >= k:
                bar = max(bar, int(np.partition(known, len(known) - k)[len(known) - k]))
                essential = int(np.searchsorted(bounds, bar))
        scored = np.flatnonzero(seen)
        rest = lists[:at]
        if rest and len(scored):
            most = np.zeros((len(rest), len(scored)), dtype=np.int64)
            for k_list, (one, weight) in enumerate(rest):
                block, held = one.block_of(scored + low)
                most[k_list] = np.where(held, one.bound[block] * weight, 0)
            may = score[scored] + most.sum(axis=0)
            for k_list in range(len(rest) - 1, -1, -1):
                stays = may >= bar
                if not stays.all():
                    scored, may, most = scored[stays], may[stays], most[:, stays]
                ask = np.flatnonzero(most[k_list])
                if not len(ask):
                    continue
                one, weight = rest[k_list]
                block, _ = one.block_of(scored[ask] + low)
                documents, values = one.postings(np.unique(block))
                place = np.minimum(np.searchsorted(documents, scored[ask] + low), len(documents) - 1)
                own = np.where(documents[place] == scored[ask] + low, values[place] * weight, 0)
                score[scored[ask]] += own
                may[ask] += own - most[k_list, ask]
        best_score, best = np.concatenate([best_score, score[scored]]), np.concatenate([best, scored + low])
        order = np.lexsort((ids[best], -best_score))[:k]
        best_score, best = best_score[order], best[order]
        if len(best) == k:
            bar = max(bar, int(best_score[-1]))
    return [(score, document) for score, document in zip(best_score.tolist(), best.tolist(), strict=True) if score > 0]


def _answering(shared, k: int):
    """The function that answers a round's queries from one shard."""
    return lambda table: _answer(*shared.value, k, table)


def _answer(queries: list[tuple[int, list[tuple[str, int]]]], n_documents: int, n_terms: int, k: int, table: pa.Table) -> pa.Table:
    names = table.column("term").to_pylist()
    head = names.index(None)
    ids, known, lengths = np.frombuffer(table.column("packed")[head].as_py(), dtype=np.int64).reshape(3, -1)
    # Places in the order of the ids, those without id last: what ties are broken by.
    order = np.lexsort((ids, 1 - known))
    rank = np.empty(len(ids), dtype=np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (np.diff(ids[order]) != 0) | (np.diff(known[order]) != 0)])) if len(ids) else 0
    by_term: dict[str, list[int]] = {}
    for row, term in enumerate(names):
        if term is not None:
            by_term.setdefault(term, []).append(row)
    numbers = {name: table.column(name).to_numpy() for name in ("block", "n", "first", "last", "most", "least")}
    data = table.column("packed").to_pylist()
    lists: dict[str, _List] = {}
    for term, rows in by_term.items():
        rows = sorted(rows, key=numbers["block"].__getitem__)
        lists[term] = _List({name: values[rows] for name, values in numbers.items()}, [data[row] for row in rows], (lengths, n_documents, n_terms))
    out = []
    for number, terms in queries:
        own = [(lists[term], weight) for term, weight in terms if term in lists]
        if own:
            out += [(number, score, document) for score, document in best_of_shard(own, rank, k)]
    columns = [np.array(column, dtype=np.int64) for column in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 3
    return pa.table({
        "query": pa.array(columns[0]), "score": pa.array(columns[1]),
        "doc_id": pa.array(ids[columns[2]], mask=known[columns[2]] == 0),
    })


class LexicalIndex:
    """An index at a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def add(self, docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> None:
        """Take in documents (doc_id, text) as new shards."""
        ship(self.spark)
        index_rows(docs, shard_bytes).write.parquet(f"{self.path}/batch={uuid.uuid4().hex}")

    def rows(self) -> DataFrame:
        return self.spark.read.schema(INDEX + ", batch string").parquet(self.path)

    def search(self, queries: DataFrame, k: int = 20, round_terms: int = ROUND_TERMS) -> DataFrame:
        """Of queries (item_id, text): item_id, rank, doc_id and score of the k best documents of each."""
        spark = self.spark
        ship(spark)
        queries = written(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", "text"), "queries")
        found = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
        pairs = written(queries.select("query", F.explode(found).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times")), "query-terms")
        rounds = 1 + pairs.count() // round_terms
        rows = self.rows()
        heads = rows.filter("term IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)), F.count("*"))
        n_documents, n_terms, shards = heads.first()
        answers = new_folder(spark, "answers")
        for number in range(rounds):
            # Some `round_terms` pairs, so all that is sent out or collected here is bounded.
            own = pairs.filter(F.pmod(F.xxhash64("query"), F.lit(rounds)) == number)
            terms = own.select("term").distinct()
            counts = rows.join(F.broadcast(terms), "term").groupBy("term").agg(F.sum("n").alias("documents")).collect() if n_terms else []
            weights = {row.term: floor(1000 * log((2 * n_documents + 2) / (2 * row.documents + 1))) for row in counts}
            by_query: dict[int, list[tuple[str, int]]] = {}
            for row in own.collect():
                if weights.get(row.term):
                    by_query.setdefault(row["query"], []).append((row.term, row.times * weights[row.term]))
            shared = spark.sparkContext.broadcast((sorted(by_query.items()), n_documents, n_terms))
            wanted = F.broadcast(terms.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("term"))).withColumnRenamed("term", "wanted"))
            postings = rows.join(wanted, F.col("term").eqNullSafe(F.col("wanted")), "left_semi")
            # Shards take long for their size, so each may be a task of its own.
            postings = postings.repartition(max(1, min(shards, MOST_TASKS)), "batch", "shard")
            best = postings.groupBy("batch", "shard").applyInArrow(_answering(shared, k), ANSWERS)
            best.write.mode("append").parquet(answers)
            shared.unpersist()
        best = spark.read.schema(ANSWERS).parquet(answers)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        best = best.select("*", place.alias("rank")).filter(F.col("rank") <= k)
        return best.join(queries.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
