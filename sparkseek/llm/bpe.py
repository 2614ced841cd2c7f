"""Byte-level BPE by merge replay over a table of words.

Text is split by the tokenizer's pattern into words that merge independently of each other. The replay works on the
distinct words of a block of the corpus at once: an inverted index holds, for each token that a merge can form, the
positions of its pairs in those words; merges are applied in rank order, each to all words that hold it in one step over
arrays, and only the two neighbours of a merged pair get new index entries. Because merges never cross words, replaying blocks of the corpus in
parallel gives the same ids as one replay over the whole corpus, and no word table has to be shuffled or broadcast. Words
that earlier blocks of a task brought are kept, up to a bound in bytes, and aren't replayed again.

Defined results: a null text encodes as an empty text, to no ids; null ids decode to empty bytes; special tokens are
never recognised; extra columns pass through; texts of any length are encoded whole, a single word of any length in
n log n steps. An id outside the vocabulary raises KeyError.
"""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..shipping import ship
from .arrow import with_columns

#: Bytes of words with their ids that a task remembers between blocks, and pairs of tokens.
REMEMBERED_BYTES = 48 << 20
REMEMBERED_PAIRS = 150_000
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 190
#: Text bytes in a block.
BLOCK_BYTES = 4 << 20
#: Bytes of a word from which its pairs are merged one by one: the arrays merge one pair of a word in a step.
LONG_WORD = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class _Partners:
    """For each token the tokens beside it, on one side, with which it forms a token, and what they form."""

    def __init__(self, own: np.ndarray, other: np.ndarray, formed: np.ndarray, n_tokens: int):
        order = np.lexsort((other, own))
        self.other, self.formed = other[order], formed[order]
        self.cuts = np.searchsorted(own[order], np.arange(n_tokens + 1)).tolist()

    def form(self, token: int, others: np.ndarray) -> np.ndarray:
        """What a token forms with each of the others, -1 if nothing."""
        start, end = self.cuts[token], self.cuts[token + 1]
        if start == end:
            return np.full(len(others), -1, dtype=np.int32)
        known = self.other[start:end]
        place = np.minimum(known.searchsorted(others), end - start - 1)
        return np.where(known[place] == others, self.formed[start:end][place], np.int32(-1))


class Replay:
    """Merges by rank order over many words."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.base = np.full((256, 256), -1, dtype=np.int32)
        splits = []
        for token, rank in ranks.items():
            if len(token) == 2:
                self.base[token[0], token[1]] = rank
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    splits.append((left, right, rank))
        left, right, formed = np.array(splits, dtype=np.int32).reshape(-1, 3).T
        n_tokens = max(ranks.values()) + 1
        self.following, self.preceding = _Partners(left, right, formed, n_tokens), _Partners(right, left, formed, n_tokens)
        self.known: dict[tuple[int, int], int | None] = {}

    def encode(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word."""
        return [tuple(np.frombuffer(ids, dtype=np.int32).tolist()) for ids in self.packed(words)]

    def packed(self, words: list[bytes]) -> list[bytes]:
        """The same as 32-bit numbers. A word that is a token itself needs no merges."""
        ranks = self.ranks
        out = [ranks[word].to_bytes(4, sys.byteorder) if word in ranks else b"" for word in words]
        short = [i for i, word in enumerate(words) if 0 < len(word) < LONG_WORD and not out[i]]
        long = [i for i, word in enumerate(words) if len(word) >= LONG_WORD and not out[i]]
        for i, ids in chain(zip(short, self._merge_at_once([words[i] for i in short]), strict=True), zip(long, self._merge([words[i] for i in long]), strict=True)):
            out[i] = ids
        return out

    def _merge_at_once(self, words: list[bytes]) -> Iterable[bytes]:
        """Merges of many short words: one step takes the first pair of a rank in every word that has it."""
        if not words:
            return []
        # All words lie in one row of symbols. after/before skip symbols that went into a merge; place n, which no token
        # stands at, lies beyond both ends of every word.
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(word) for word in words], dtype=np.int32)
        ends = np.cumsum(sizes)
        n = len(data)
        word = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        symbol = np.append(self.single[data], np.int32(-1))
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[ends - sizes] = n
        pair = np.full(n + 1, -1, dtype=np.int32)
        pair[: n - 1] = self.base[data[:-1], data[1:]]
        pair[ends - 1] = -1
        stands = np.ones(n, dtype=bool)
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        formed, cuts = np.unique(pair[at], return_index=True)
        places = {rank: part.tolist() for rank, part in zip(formed.tolist(), np.split(at, cuts[1:]) if len(at) else [], strict=True)}
        queue = list(places)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            at = np.array(places.pop(rank, ()), dtype=np.int64)
            at = at[pair[at] == rank]  # others' neighbours went into another merge
            if not len(at):
                continue
            if len(at) > 1:
                at.sort()
                own = word[at]
                again = np.flatnonzero(own[1:] == own[:-1]) + 1
                if len(again):
                    # A merge may make an earlier one possible: that comes first, then the rest of this one.
                    places[rank] = at[again].tolist()
                    heapq.heappush(queue, rank)
                    at = np.delete(at, again)
            right, previous = after[at], before[at]
            following = after[right]
            symbol[at] = rank
            after[at] = following
            before[following] = at
            pair[right] = -1
            stands[right] = False
            for place, new in ((at, self.following.form(rank, symbol[following])), (previous, self.preceding.form(rank, symbol[previous]))):
                pair[place] = new
                good = new >= 0
                for lower, where in zip(new[good].tolist(), place[good].tolist(), strict=True):
                    if lower in places:
                        places[lower].append(where)
                    else:
                        places[lower] = [where]
                        heapq.heappush(queue, lower)
        kept = np.flatnonzero(stands)
        ids = symbol[kept].tobytes()
        cuts = np.append(0, 4 * np.cumsum(np.bincount(word[kept], minlength=len(words)))).tolist()
        return [ids[start:end] for start, end in zip(cuts[:-1], cuts[1:], strict=True)]

    def _merge(self, words: list[bytes]) -> list[bytes]:
        """Merges of words of any length: one step takes one pair."""
        if not words:
            return []
        if len(self.known) > REMEMBERED_PAIRS:
            self.known.clear()
        known, ranks, token = self.known, self.ranks, self.token
        # All words lie in one row of symbols. after/before skip symbols that went into a merge; -1 ends a word.
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        ends = np.cumsum([len(word) for word in words])
        n = len(data)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends[ends > 0] - 1] = -1
        starts = np.concatenate([[0], ends[:-1]])
        before[starts[starts < n]] = -1
        pair = np.full(n, -1, dtype=np.int64)
        pair[:-1] = self.base[data[:-1], data[1:]]
        pair[after == -1] = -1
        at = np.flatnonzero(pair >= 0)
        at = at[np.argsort(pair[at], kind="stable")]
        formed, cuts = np.unique(pair[at], return_index=True)
        places = {rank: part.tolist() for rank, part in zip(formed.tolist(), np.split(at, cuts[1:]) if len(at) else [], strict=True)}
        queue = list(places)
        heapq.heapify(queue)
        symbol, after, before, pair = self.single[data].tolist(), after.tolist(), before.tolist(), pair.tolist()
        while queue:
            rank = heapq.heappop(queue)
            positions = places.pop(rank, None)
            if positions is None:
                continue
            positions.sort()
            for done, left in enumerate(positions):
                if pair[left] != rank:
                    continue  # a neighbour went into another merge
                right = after[left]
                following = after[right]
                symbol[left] = rank
                after[left] = following
                pair[right] = -1
                lowest = rank
                if following >= 0:
                    before[following] = left
                    key = (rank, symbol[following])
                    new = known.get(key, -1)
                    if new == -1:
                        new = known[key] = ranks.get(token[rank] + token[key[1]])
                    if new is None:
                        pair[left] = -1
                    else:
                        pair[left] = new
                        lowest = min(lowest, new)
                        if new in places:
                            places[new].append(left)
                        else:
                            places[new] = [left]
                            heapq.heappush(queue, new)
                else:
                    pair[left] = -1
                previous = before[left]
                if previous >= 0:
                    key = (symbol[previous], rank)
                    new = known.get(key, -1)
                    if new == -1:
                        new = known[key] = ranks.get(token[key[0]] + token[rank])
                    if new is None:
                        pair[previous] = -1
                    else:
                        pair[previous] = new
                        lowest = min(lowest, new)
                        if new in places:
                            places[new].append(previous)
                        else:
                            places[new] = [previous]
                            heapq.heappush(queue, new)
                if lowest < rank:
                    # The merge made an earlier one possible: that comes first, then the rest of this one.
                    places[rank] = positions[done + 1 :] + places.get(rank, [])
                    heapq.heappush(queue, rank)
                    break
        out = []
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            ids = []
            place = start if end > start else -1
            while place >= 0:
                ids.append(symbol[place])
                place = after[place]
            out.append(np.array(ids, dtype=np.int32).tobytes())
        return out


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's matches in a text, as `regex` finds them.

    Most texts stay within the first blocks of Unicode. For those the standard library's engine, twice as fast, takes the
    same pattern with letters, digits and white space of these blocks written out.
    """
    full = regex.compile(pattern).findall
    last = 0x24F
    inside = {kind: "".join(regex.escape(chr(c)) for c in range(last + 1) if regex.match(kind, chr(c))) for kind in (r"\p{L}", r"\p{N}", r"\s")}
    plain, in_set = "", False
    for part in re.findall(r"\\p\{\w+\}|\\.|.", pattern, re.S):
        in_set = part == "[" or in_set and part != "]"
        if part == r"\S" and not in_set:
            plain += f"[^{inside[r'\s']}]"
        elif part in inside:
            plain += inside[part] if in_set else f"[{inside[part]}]"
        elif re.fullmatch(r"\\[pPwWdDbBS].*", part):
            return full
        else:
            plain += part
    quick, beyond = re.compile(plain).findall, re.compile(f"[^\0-{chr(last)}]").search
    return lambda text: full(text) if beyond(text) else quick(text)


def _encode(vocabulary: Broadcast, pattern: str, decoded: bool = False):
    """Ids of texts, and with `decoded` the bytes that those ids stand for."""

    def prepare():
        split, replay = splitter(pattern), Replay(vocabulary.value)
        token = replay.token.__getitem__
        ids_of: dict[str, bytes] = {}
        size = 0

        def run(texts: list) -> list[pa.Array]:
            nonlocal size
            if size > REMEMBERED_BYTES:
                ids_of.clear()
                size = 0
            split_texts = [split(text) if text else [] for text in texts]
            fresh = list(set(chain.from_iterable(split_texts)).difference(ids_of))
            for word, packed in zip(fresh, replay.packed([word.encode() for word in fresh]), strict=True):
                ids_of[word] = packed
                size += ENTRY_BYTES + len(word) + len(packed)
            values = [b"".join(map(ids_of.__getitem__, words)) for words in split_texts]
            offsets = np.cumsum([0, *(len(value) // 4 for value in values)])
            flat = np.frombuffer(b"".join(values), dtype=np.int32)
            found = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
            if decoded:
                found.append(pa.array([b"".join(map(token, np.frombuffer(value, dtype=np.int32).tolist())) for value in values], pa.binary()))
            return found

        return run

    return prepare


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The frame with a column of token ids. The vocabulary has a fixed size and is broadcast."""
    spark = docs.sparkSession
    ship(spark)
    return with_columns(docs, text, f"`{ids}` array<int>", _encode(spark.sparkContext.broadcast(ranks), pattern), BLOCK_BYTES)


def decode(tokens: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """The frame with the bytes that a column of token ids stands for."""
    spark: SparkSession = tokens.sparkSession
    ship(spark)
    vocabulary = spark.sparkContext.broadcast({rank: token for token, rank in ranks.items()})
    schema = StructType([*tokens.schema.fields, StructField(decoded, BinaryType())])

    def run(batches):
        token = vocabulary.value.__getitem__
        for batch in batches:
            column = batch.column(ids)
            values = [b"".join(map(token, row.values.to_pylist())) if row.is_valid else b"" for row in column]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.binary())], names=schema.names)

    return tokens.mapInArrow(run, schema)


def with_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """Of documents (doc_id, text): doc_id, ids, n_tokens, and SHA-256 of the ids in decimal, joined by commas, and of the decoded bytes.

    Encodes and decodes in one pass, so that a task needs one Python worker."""
    spark = docs.sparkSession
    ship(spark)
    function = _encode(spark.sparkContext.broadcast(ranks), pattern, decoded=True)
    decoded = with_columns(docs.select("doc_id", "text"), "text", "ids array<int>, decoded binary", function, BLOCK_BYTES)
    return decoded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
