"""Set-similarity join of documents over word shingles, filtered under several global orders.

Two documents link when the Jaccard similarity of their sets of word shingles is large enough: by default shingles of 3
words and 0.9, which is what op9 asks for; both are arguments (`Rule`). If so, in any order of all shingles, they share some
of the first ones of either set: with t for the similarity, the first |x| - ceil(t |x|) + l shingles of both hold the first
l that they have in common. That is used three times, with more and more selective orders.

1. Order by hash, l a share of the set. Each document, in its block, reports that prefix; a document of whose prefix fewer
   than l shingles occur in other documents links with none. Of equal sets, one goes on.
2. Of those that are left the whole sets are reported, so for each shingle the number of blocks that hold it is known. Less
   than the share t of a set in other documents: no link. Three orders follow, all by rising number of blocks (shingles of one
   document first, which can match nothing), ties by three different hashes, the second and third by the number's
   magnitude only. The prefixes under each are a document's profile.
3. Documents that share a prefix shingle under the first order are gathered, transitively, into clusters; clusters are cut
   into chunks, and each pair of chunks is one task's work. It counts, with inverted lists, whether two sets share a prefix
   shingle under the first, the second and the third order; only pairs that pass all three and fit in size are verified by
   the size of their intersection. A task gives a spanning forest of its links and each document's number of links.

The components of those forests are the classes. Nothing is capped: a hot shingle is one row per block, a hot set is one
row per block, a cluster of any size is worked through in bounded chunks.

Defined results: null and empty texts have no shingles and link with nothing, not even each other; fewer words than
a shingle has are one shingle; a null doc_id has neither class nor links (component_id null); of rows that share a doc_id each is a
document of its own; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import free_name, join_groups, numbered_rows, total_bytes, written
from .components import components
from .memory import of_group, of_groups
from .recurring import block_of, marked, of_several, several
from .words import Words, members, mixed, text_pieces

#: What op9 asks for: words of a shingle, and the similarity in hundredths.
SHINGLE = 3
LEAST = 90
#: The first pass asks for this share of a set, in hundredths, beyond the plain prefix.
SHARE = 12
#: Documents in one chunk of a cluster.
CHUNK = 256
ORDERS = 3
#: Bytes of texts, or of sets, in one block.
BLOCK_BYTES = 4 << 20

SETS = "row long, doc_id long, n_shingles long, set binary, shingles binary"
PROFILES = "row long, n long, shingles binary, " + ", ".join(f"prefix{k} binary" for k in range(ORDERS))


def _upto(value: int, of: int) -> int:
    return -(-value // of)


class Rule(NamedTuple):
    """When two sets link: words of a shingle, and the least similarity in hundredths."""

    shingle: int = SHINGLE
    least: int = LEAST

    def needed(self, n: int) -> int:
        """Shingles of a set of n that a linked set must hold."""
        return _upto(n * self.least, 100)

    def largest(self, n: int) -> int:
        """No set that links with one of n has more shingles."""
        return _upto(n * 100, self.least)

    def asked(self, n: int) -> int:
        """Shingles that the first pass asks for; never more than are needed."""
        return _upto(n * min(SHARE, self.least), 100)


def lower(text: str | None) -> bytes:
    return text.encode().lower() if text else b""


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The distinct hashed shingles of each text, sorted; words are hashed for a bounded piece of the texts at a time."""
    for piece in text_pieces(texts):
        words = Words(piece)
        runs = [words.runs(length, length) for length in range(1, shingle + 1)]
        for start, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            length = min(shingle, end - start)
            yield np.unique(runs[length - 1][start : end - length + 1]) if length else np.zeros(0, dtype=np.uint64)


def _report_prefixes(rule: Rule, key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    shingles, document = [], []
    sets = shingle_sets([lower(text) for text in table.column("text").to_pylist()], rule.shingle)
    for k, (own, doc_id) in enumerate(zip(sets, table.column("doc_id").to_pylist(), strict=True)):
        if doc_id is not None and len(own):
            n = len(own)
            # Long enough for any linked document's share.
            part = own[: n - rule.needed(n) + rule.asked(rule.largest(n))]
            shingles.append(part)
            document.append(np.full(len(part), k))
    if not shingles:
        return pa.table({"shingle": pa.array([], pa.int64()), "mark": pa.array([], pa.int64())})
    found, many = several(np.concatenate(shingles), np.concatenate(document))
    return pa.table({"shingle": pa.array(found.view(np.int64)), "mark": marked(key[0].as_py(), many)})


def _sets(rule: Rule, key: tuple[pa.Scalar, ...], docs: pa.Table, seen: pa.Table) -> pa.Table:
    """Every document's set size and fingerprint; the set itself where the document may link and is the first of its set."""
    known = np.sort(seen.column("shingle").to_numpy().astype(np.int64).view(np.uint64))
    rows, ids = docs.column("row").to_pylist(), docs.column("doc_id").to_pylist()
    order = np.argsort(rows, kind="stable").tolist()
    sets = list(shingle_sets([lower(text) for text in docs.column("text").to_pylist()], rule.shingle))
    out, first = [], set()
    for k in order:
        own, n = sets[k], len(sets[k])
        mark = whole = None
        if n and ids[k] is not None:
            mark = np.array([(own * mixed(own)).sum(dtype=np.uint64), mixed(own, 0x2545F4914F6CDD1D).sum(dtype=np.uint64)]).tobytes()
            asked = rule.asked(n)
            if mark not in first and members(own[: n - rule.needed(n) + asked], known).sum() >= asked:
                whole = own.tobytes()
            first.add(mark)
        out.append((rows[k], ids[k], n, mark, whole))
    return pa.table(
        [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
        names=["row", "doc_id", "n_shingles", "set", "shingles"],
    )


def _numbers(packed: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(one, dtype=np.uint64) for one in packed.to_pylist()]


def _first_of_sets(table: pa.Table) -> pa.Table:
    """Of equal sets, which lie in one block, the one with the smallest row."""
    return table.sort_by("row").group_by("set", use_threads=False).aggregate([("row", "first"), ("shingles", "first")]).rename_columns(["set", "row", "shingles"])


def _report_shingles(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    sets = _numbers(_first_of_sets(table).column("shingles"))
    found, many = several(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(one) for one in sets]))
    return pa.table({"shingle": pa.array(found.view(np.int64)), "mark": marked(key[0].as_py(), many)})


def _profiles(rule: Rule, key: tuple[pa.Scalar, ...], sets: pa.Table, seen: pa.Table) -> pa.Table:
    sets = _first_of_sets(sets)
    known = seen.column("shingle").to_numpy().astype(np.int64).view(np.uint64)
    blocks = seen.column("blocks").to_numpy().astype(np.int64)
    order = np.argsort(known)
    known, blocks = known[order], blocks[order]
    out = []
    for row, own in zip(sets.column("row").to_pylist(), _numbers(sets.column("shingles")), strict=True):
        n = len(own)
        shared = own[members(own, known)]
        room = n - rule.needed(n) + 1 - (n - len(shared))
        if room > 0:
            often = blocks[np.searchsorted(known, shared)]
            weights = [often, *[np.log2(often).astype(np.int64)] * (ORDERS - 1)]
            parts = [shared[np.lexsort((mixed(shared, k), weights[k]))[:room]].tobytes() for k in range(ORDERS)]
            out.append((row, n, own.tobytes(), *parts))
    columns = zip(*out, strict=True) if out else [[]] * (3 + ORDERS)
    kinds = [pa.int64(), pa.int64(), *[pa.binary()] * (1 + ORDERS)]
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["row", "n", "shingles", *[f"prefix{k}" for k in range(ORDERS)]])


class _Inverted:
    """For each number, the sets that hold it."""

    def __init__(self, sets: list[np.ndarray]):
        numbers = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(one) for one in sets])
        order = np.argsort(numbers, kind="stable")
        self.owner, self.n = owner[order], len(sets)
        self.numbers, start = np.unique(numbers[order], return_index=True)
        self.start, self.end = start, np.append(start[1:], len(numbers))

    def shared(self, own: np.ndarray) -> np.ndarray:
        """How many of the numbers each set holds."""
        place = np.searchsorted(self.numbers, own)
        place = place[(place < len(self.numbers)) & (self.numbers[np.minimum(place, len(self.numbers) - 1)] == own)]
        start, count = self.start[place], self.end[place] - self.start[place]
        if not len(place):
            return np.zeros(self.n, dtype=np.int64)
        at = np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=self.n)


def _linked(least: int, key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between two chunks of a cluster (or within one): a spanning forest, and for each document its number of links."""
    chunk, one, two = table.column("chunk").to_numpy(), key[1].as_py(), key[2].as_py()
    rows, n, documents = (table.column(name).to_numpy() for name in ("row", "n", "documents"))
    sets = _numbers(table.column("shingles"))
    prefixes = [_numbers(table.column(f"prefix{k}")) for k in range(ORDERS)]
    left, right = np.flatnonzero(chunk == one), np.flatnonzero(chunk == two)
    links = np.zeros(len(rows), dtype=np.int64)
    above = list(range(len(rows)))
    edges = []

    def root(k: int) -> int:
        while above[k] != k:
            above[k] = above[above[k]]
            k = above[k]
        return k

    if len(left) and len(right):
        by_prefix = [_Inverted([prefix[k] for k in right]) for prefix in prefixes]
        by_shingle = _Inverted([sets[k] for k in right])
        for x in left.tolist():
            may = (n[right] * 100 >= least * n[x]) & (n[x] * 100 >= least * n[right])
            if one == two:
                may &= right > x
            for prefix, inverted in zip(prefixes, by_prefix, strict=True):
                if may.any():
                    may &= inverted.shared(prefix[x]) > 0
            if not may.any():
                continue
            both = by_shingle.shared(sets[x])
            for y in right[may & (100 * both >= least * (n[x] + n[right] - both))].tolist():
                links[x] += documents[y]
                links[y] += documents[x]
                a, b = root(x), root(y)
                if a != b:
                    above[max(a, b)] = min(a, b)
                    edges.append((rows[x], rows[y]))
    some = np.flatnonzero(links)
    return pa.table({
        "a": pa.array([e[0] for e in edges] + rows[some].tolist(), pa.int64()),
        "b": pa.array([e[1] for e in edges] + [None] * len(some), pa.int64()),
        "links": pa.array([None] * len(edges) + links[some].tolist(), pa.int64()),
    })


def link_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES, chunk: int = CHUNK, shingle: int = SHINGLE, least: int = LEAST, row: str | None = None) -> DataFrame:
    """Of documents (doc_id, text): row, doc_id, n_shingles, component_id, n_links (the number of documents it links with).

    Documents link whose sets of shingles of `shingle` words have a similarity of `least` hundredths or more.
    `row` of the result numbers the rows, with the numbers of the column `row` if it is given; that column must be stored,
    not computed, as several passes read it.
    """
    if shingle < 1 or not 1 <= least <= 100:
        raise ValueError("shingle is a number of words, least a similarity in hundredths")
    ship(docs.sparkSession)
    rule = Rule(shingle, least)
    docs = numbered_rows(docs.select("doc_id", "text")) if row is None else docs.select("doc_id", "text", F.col(row).alias("row"))
    block = block_of(total_bytes(docs), F.col("doc_id"), F.octet_length("text"), block_bytes=block_bytes)
    dealt = docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block")).groupBy("block")
    seen = of_several(dealt.applyInArrow(of_group(lambda key, table: _report_prefixes(rule, key, table)), "shingle long, mark long"), ["shingle"]).select("block", "shingle")
    sets = written(dealt.cogroup(seen.groupBy("block")).applyInArrow(of_groups(lambda key, docs, seen: _sets(rule, key, docs, seen)), SETS), "shingle-sets")

    classes = sets.filter("set IS NOT NULL").groupBy("set").agg(F.min("row").alias("node"), F.min("doc_id").alias("least"), F.count("*").alias("documents"))
    classes = written(classes, "set-classes")
    open_sets = sets.filter("shingles IS NOT NULL").select("row", "set", "shingles")
    size = sets.agg(F.coalesce(F.sum(F.octet_length("shingles")), F.lit(0))).first()[0]
    dealt = open_sets.withColumn("block", block_of(size, F.col("set"), block_bytes=block_bytes)).groupBy("block")
    seen = of_several(dealt.applyInArrow(of_group(_report_shingles), "shingle long, mark long"), ["shingle"]).select("block", "shingle", F.col("blocks_").alias("blocks"))
    profiles = written(dealt.cogroup(seen.groupBy("block")).applyInArrow(of_groups(lambda key, sets, seen: _profiles(rule, key, sets, seen)), PROFILES), "profiles")

    links = written(_links_of_clusters(profiles, classes, chunk, least), "links")
    roots = components(links.filter("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "row")
    classes = classes.withColumnRenamed("node", "row").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    partners = links.filter("links IS NOT NULL").groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("links"))
    classes = classes.join(partners, "row", "left")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0)) + F.col("documents") - 1
    classes = written(classes.join(smallest, "root").select("set", "documents", "component_id", n_links.alias("n_links")), "classes")
    total = classes.agg(F.coalesce(F.sum("documents"), F.lit(0))).first()[0]
    columns = ["row", "doc_id", "n_shingles", "component_id", "n_links"]
    alone = sets.filter("set IS NULL").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    members_of = join_groups(sets.filter("set IS NOT NULL").drop("shingles"), classes, "set", "documents", total)
    return members_of.select(columns).unionByName(alone)


def kept(docs: DataFrame, shingle: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """One document of each class, the one with the smallest doc_id; documents without a class stay. All columns pass through."""
    row = free_name(docs, "row")
    docs = numbered_rows(docs, row)
    found = link_documents(docs, shingle=shingle, least=least, row=row)
    # Of rows that share the smallest doc_id of a class, the first stays.
    first = found.filter("doc_id = component_id AND n_links > 0").groupBy("component_id").agg(F.min("row").alias("row"))
    gone = found.filter("n_links > 0").select("row").join(first.select("row"), "row", "left_anti").withColumnRenamed("row", row)
    return docs.join(gone, row, "left_anti").drop(row)


def _links_of_clusters(profiles: DataFrame, classes: DataFrame, chunk: int, least: int) -> DataFrame:
    unpacked = profiles.select("row", "prefix0").mapInArrow(_unpack, "row long, shingle long")
    tokens = written(unpacked, "prefix-shingles")
    heads = tokens.groupBy("shingle").agg(F.min("row").alias("head"), F.count("*").alias("size")).filter("size > 1")
    heads = written(heads, "prefix-heads")
    total = heads.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    near = join_groups(tokens, heads, "shingle", "size", total).select(F.col("head").alias("a"), F.col("row").alias("b"))
    clusters = components(near)
    sizes = clusters.groupBy("root").agg(F.count("*").alias("size"))
    chunks = (1 + F.floor(F.col("size") / chunk)).cast("long")
    placed = clusters.join(sizes, "root").select(F.col("node").alias("row"), F.col("root").alias("cluster"), chunks.alias("chunks"))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.col("chunks")))
    full = profiles.join(placed, "row").join(classes.select(F.col("node").alias("row"), "documents"), "row")
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    pairs = pairs.withColumn("one", F.least("chunk", "other")).withColumn("two", F.greatest("chunk", "other")).drop("other", "chunks")
    return pairs.groupBy("cluster", "one", "two").applyInArrow(of_group(lambda key, table: _linked(least, key, table)), "a long, b long, links long")


def _unpack(batches):
    for batch in batches:
        parts = _numbers(batch.column("prefix0"))
        rows = np.repeat(batch.column("row").to_numpy(), [len(one) for one in parts])
        shingles = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(shingles)], names=["row", "shingle"])
