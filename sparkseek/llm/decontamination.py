"""Benchmark decontamination by Wu-Manber search over words.

A test item is cut into windows of 13 consecutive words (an item of fewer words is one window). Windows of one length form
a search table: for each pair of neighbouring words the table holds how far a search may jump when it sees that pair, so
most positions of a document are never looked at; a pair that ends a window leads to a bucket of the windows with that
suffix, keyed by their first word; those are compared word by word with the document.

The benchmark is the query set. It is taken through the driver in blocks of bounded size, each broadcast as text; a task
searches a piece of its documents for one block after the other, and its rows never move.

Defined results: null and empty texts have no words and no hits; items without words match nothing; a null item_id takes
part in hits but isn't listed; several rows with one item_id count as one item; an empty benchmark gives no hits. Extra
columns pass through. Texts are searched whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrow import with_columns

WINDOW = 13
#: Text bytes of the test items that are searched for at a time.
BLOCK_BYTES = 2 << 20

_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    """Words of ASCII digits and letters, lower-cased, and of all characters beyond ASCII."""
    return _WORDS.findall(text.encode().lower()) if text else []


class WuManber:
    """Searches word lists for all windows of one length."""

    def __init__(self, length: int, windows: list[tuple[list[bytes], int, int]]):
        """windows: (words of the item, place of the window in it, number of the item)."""
        self.length, self.block = length, min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for item, start, number in windows:
            for last in range(self.block - 1, length):
                pair = self._pair(item, start + last)
                self.shift[pair] = min(self.shift.get(pair, self.jump), length - 1 - last)
            ends_with = self.buckets.setdefault(self._pair(item, start + length - 1), {})
            ends_with.setdefault(item[start], []).append((item, start, number))

    def _pair(self, row: list[bytes], last: int):
        return (row[last - 1], row[last]) if self.block == 2 else row[last]

    def search(self, row: list[bytes]) -> Iterator[tuple[int, int]]:
        """(place, number of the item) of every occurrence."""
        length, jump, shift, two = self.length, self.jump, self.shift, self.block == 2
        last, n = length - 1, len(row)
        while last < n:
            pair = (row[last - 1], row[last]) if two else row[last]
            step = shift.get(pair, jump)
            if step:
                last += step
                continue
            first = last - length + 1
            for item, start, number in self.buckets[pair].get(row[first], ()):
                if item[start : start + length] == row[first : last + 1]:
                    yield first, number
            last += 1


def compile_items(items: list[tuple[str | None, str]], window: int) -> list[WuManber]:
    by_length: dict[int, list] = {}
    for number, (_, text) in enumerate(items):
        row = words(text)
        length = min(window, len(row))
        if length:
            by_length.setdefault(length, []).extend((row, start, number) for start in range(len(row) - length + 1))
    return [WuManber(length, windows) for length, windows in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), F.col("text")).filter("text IS NOT NULL").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(blocks: list[Broadcast], window: int):
    def prepare():
        compiled: dict[int, list[WuManber]] = {}

        def run(texts: list) -> list[pa.Array]:
            rows = [words(text) for text in texts]
            spans: list[list] = [[] for _ in rows]
            items: list[set] = [set() for _ in rows]
            for place, block in enumerate(blocks):
                ids = block.value
                if place not in compiled:
                    compiled.clear()  # one block's tables at a time
                    compiled[place] = compile_items(ids, window)
                for table in compiled[place]:
                    for row, own, found in zip(rows, spans, items, strict=True):
                        for first, number in table.search(row):
                            own.append((first, first + table.length))
                            if ids[number][0] is not None:
                                found.add(ids[number][0])
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return [
                pa.array([len(row) for row in rows], pa.int64()),
                pa.array([_merged(own) for own in spans], span),
                pa.array([sorted(found) for found in items], pa.list_(pa.string())),
            ]

        return run

    return prepare


def _merged(spans: list[tuple[int, int]]) -> list[dict]:
    merged: list[dict] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1]["end"]:
            merged[-1]["end"] = max(end, merged[-1]["end"])
        else:
            merged.append({"start": start, "end": end})
    return merged


def find_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
               names: tuple[str, str, str] = ("n_words", "hits", "items")) -> DataFrame:
    """The frame with the number of words, the spans of hit words (merged, end exclusive) and the item_ids that occur, sorted as strings."""
    spark = docs.sparkSession
    ship(spark)
    blocks = [spark.sparkContext.broadcast(block) for block in _blocks(benchmark, block_bytes)]
    n_words, hits, items = names
    added = f"`{n_words}` bigint, `{hits}` array<struct<start:int,end:int>>, `{items}` array<string>"
    return with_columns(docs, text, added, _search(blocks, window))


def hit_words(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0).cast("long"), lambda total, span: total + span["end"] - span["start"])


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least one hit word, and at least a twentieth of the words."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with their own columns."""
    mark = "_decontamination_"
    while any(name.lower().startswith(mark) for name in docs.columns):
        mark += "_"
    names = (f"{mark}words", f"{mark}hits", f"{mark}items")
    found = find_items(docs, benchmark, names=names)
    return found.filter(~is_contaminated(F.col(names[0]), hit_words(F.col(names[1])))).drop(*names)
