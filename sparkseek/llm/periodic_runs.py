"""Periodic runs of words: stretches in which the same few words follow each other again and again.

A run is a maximal stretch with a smallest period q that is long enough: `copies` times q and `shortest` words at least. Per
document:

1. Every run of five words inside such a stretch occurs again at distance q in it, so stretches of words whose five-word
   runs have no near twin hold no run. Those are left out; nothing that a run needs is (see `_stretches`).
2. In each stretch that is left, suffixes are sorted into groups by their longest Lyndon prefix, from the largest group
   down: the first phase of a two-phase suffix sorter by grouping. A suffix's group, when its turn comes, has the length of
   that prefix. That is done under an order of the words and under its reverse.
3. Three or more equal Lyndon prefixes on end are the roots of a candidate; comparing the words at distance q to either
   side (longest common extension) gives its borders, and its length decides.

Defined results: null and empty texts have no words and no runs; a null doc_id is a document like others; rows that share a
doc_id are documents of their own; extra columns are ignored; an empty table gives no rows; texts are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .arrow import pieces
from .common import BLANKS
from .words import Words, mixed

#: Copies of its period, and words, that a run has at least.
COPIES = 4
SHORTEST = 6
#: Words in the runs that must occur again. In a stretch of 4 q words, 6 at least, each word lies in one that does.
TWIN = 5

RESULT = "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def lyndon_lengths(words: list[int]) -> list[int]:
    """Length of the longest Lyndon prefix of each suffix; a suffix that is the start of another one is the smaller."""
    n = len(words)
    kinds = {word: k for k, word in enumerate(sorted(set(words)))}
    of = [kinds[word] for word in words]
    members: list[list[int]] = [[] for _ in kinds]
    for place, group in enumerate(of):
        members[group].append(place)
    size = [1] * len(kinds)
    below = list(range(-1, len(kinds) - 1))
    above = [*range(1, len(kinds)), -1]
    before = list(range(-1, n - 1))
    lengths = [0] * n  # 0: its group's turn has not come
    group = len(kinds) - 1
    while group >= 0:
        own = [place for place in members[group] if of[place] == group]
        members[group] = []
        length = size[group]
        for place in own:
            lengths[place] = length
        copies: dict[int, int] = {}
        for place in own:
            # The nearest place before whose turn has not come is followed by this group's prefix, once or several times.
            at, last = before[place], place
            while at >= 0 and lengths[at]:
                before[last] = before[at]
                last, at = at, before[at]
            before[place] = at
            if at >= 0:
                copies[at] = copies.get(at, 0) + 1
        fresh: dict[tuple[int, int], int] = {}
        several = len(copies) > 1 and max(copies.values()) > 1
        for at in sorted(copies, key=copies.__getitem__, reverse=True) if several else copies:
            key = (of[at], copies[at])
            into = fresh.get(key)
            if into is None:
                # Right above the group it comes from, and below those with more copies.
                old, into = key[0], len(size)
                fresh[key] = into
                size.append(size[old] + key[1] * length)
                members.append([])
                below.append(old)
                above.append(above[old])
                if above[old] >= 0:
                    below[above[old]] = into
                above[old] = into
            of[at] = into
            members[into].append(at)
        group = below[group]
    return lengths


def _common(words: np.ndarray, at: int, step: int, by: int) -> int:
    """How many words from `at` on, in the direction of step (1 or -1), equal those `by` further on."""
    found, block = 0, 16
    while True:
        if step > 0:
            most = min(block, len(words) - by - at - found)
            equal = words[at + found : at + found + most] == words[at + found + by : at + found + by + most]
        else:
            most = min(block, at - found + 1)
            low = at - found - most + 1
            equal = (words[low : low + most] == words[low + by : low + by + most])[::-1]
        if most <= 0:
            return found
        if not equal.all():
            return found + int(np.argmin(equal))
        found += most
        block *= 2


def runs_of(words: np.ndarray, copies: int = COPIES, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of word numbers, sorted; copies is 4 at least."""
    found = set()
    n = len(words)
    for order in (words, -words):
        lengths = np.array(lyndon_lengths(order.tolist()), dtype=np.int64)
        place = np.arange(n)
        last = np.minimum(place + 2 * lengths, n - 1)
        second = np.minimum(place + lengths, n - 1)
        root = (place + 3 * lengths <= n) & (lengths[second] == lengths) & (lengths[last] == lengths)
        root &= (words[second] == words) & (words[last] == words)
        ends: dict[int, int] = {}
        for at, period in zip(np.flatnonzero(root).tolist(), lengths[root].tolist(), strict=True):
            # Roots of a stretch that was looked at from its first one.
            if at + 2 * period <= ends.get(period, 0):
                continue
            before = _common(words, at - 1, -1, period)
            length = before + period + _common(words, at, 1, period)
            ends[period] = at - before + length
            if length >= max(shortest, copies * period):
                found.add((at - before, length, period))
    return sorted(found)


def _stretches(words: Words) -> list[tuple[int, int, int]]:
    """(text, first word, end) of stretches outside of which no run lies, at words numbered through all texts.

    A run of q and its L >= 4 q words hold a twin, q <= L / 4 words away, of each five-word run inside. So places without a twin
    within a quarter of the stretch they lie in are dropped, which may cut a stretch; what is left is looked at again.
    """
    at = words.whole(TWIN)
    if not len(at):
        return []
    text = words.text[at]
    key = words.runs(TWIN)[at] ^ mixed(text.astype(np.uint64))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    apart = np.diff(at[order])
    near = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(near, order[1:][same], apart[same])
    np.minimum.at(near, order[:-1][same], apart[same])
    keep = near <= (words.first[text + 1] - words.first[text]) // COPIES
    at, text, near = at[keep], text[keep], near[keep]
    while len(at):
        new = np.ones(len(at), dtype=bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(at)))
        keep = near <= np.repeat((length + TWIN - 1) // COPIES, length)
        keep &= np.repeat(length + TWIN - 1 >= SHORTEST, length)
        if keep.all():
            return list(zip(text[start].tolist(), at[start].tolist(), (at[start] + length + TWIN - 1).tolist(), strict=True))
        at, text, near = at[keep], text[keep], near[keep]
    return []


def _runs_of_texts(texts: list[bytes]) -> tuple[list[int], dict[int, list[tuple[int, int, int]]]]:
    """Number of words of each text, and the runs of those that have some."""
    words = Words(texts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    split: tuple[int, list[bytes]] = (-1, [])
    for text, start, end in _stretches(words):
        first = int(words.first[text])
        if split[0] != text:
            split = (text, texts[text].split())
        numbers: dict[bytes, int] = {}
        own = np.array([numbers.setdefault(word, len(numbers)) for word in split[1][start - first : end - first]], dtype=np.int64)
        here = [(start - first + at, length, period) for at, length, period in runs_of(own)]
        if here:
            found.setdefault(text, []).extend(here)
    return np.diff(words.first).tolist(), found


def _collapsed(text: bytes, runs: list[tuple[int, int, int]]) -> str:
    """The words joined by one space, without those of a run behind its first period."""
    words = text.split()
    if runs:
        change = np.zeros(len(words) + 1, dtype=np.int64)
        for start, length, period in runs:
            change[start + period] += 1
            change[start + length] -= 1
        words = [words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def find_runs(docs: DataFrame) -> DataFrame:
    """Of documents (doc_id, text): doc_id, number of words, all runs by start and period, and the collapsed text."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text", 4 << 20):
                texts = [text.encode() if text else b"" for text in piece.column("text").to_pylist()]
                counts, found = _runs_of_texts(texts)
                runs = [sorted(found.get(k, []), key=lambda run: (run[0], run[2])) for k in range(len(texts))]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array(counts, pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], _RUNS),
                    pa.array([_collapsed(text, own) for text, own in zip(texts, runs, strict=True)], pa.string()),
                ], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one document in ten, by the checksum of its doc_id, repeats some of its words to the end."""
    checksum = F.crc32(F.col("doc_id").cast("long").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", checksum.alias("h"))
    words = F.filter(F.split("text", BLANKS), lambda word: word != "")
    chosen = (F.col("h") % 10 == 0) & F.col("text").isNotNull()
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(chosen, words).alias("words")))))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    start = g % n
    period = 1 + F.floor((n - start) / (3 + g % 8))
    rows = rows.select("*", F.when(n > 0, start).alias("start"), F.when(n > 0, period).alias("period"))
    source = lambda k: F.when(k < F.col("start"), k).otherwise(F.col("start") + (k - F.col("start")) % F.col("period"))
    places = F.sequence(F.lit(0).cast("long"), n - 1)
    changed = F.array_join(F.transform(places, lambda k: F.get("words", source(k).cast("int"))), " ")
    return rows.select("doc_id", F.when(F.col("period").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def longest(runs: Column) -> Column:
    """The run with the greatest length, of those the first start, then the smallest period; null without runs."""
    best = F.aggregate(
        runs, runs[0],
        lambda best, run: F.when(run["length"] > best["length"], run).otherwise(best),
    )
    return F.when(F.size(runs) > 0, best)
