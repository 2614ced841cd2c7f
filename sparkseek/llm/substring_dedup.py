"""Removing passages that an earlier document holds, with Aho-Corasick automata over words.

Every run of 13 words (a window) that starts in several documents belongs to the one with the smallest doc_id; in all
others its words go. Documents lie in blocks of bounded size, dealt in one shuffle that all passes read:

1. Each window is stood for by an anchor, the 5-word run in it with the smallest hash. Neighbouring windows share anchors,
   so only about one word in five is reported. Anchors found in one document only rule out all their windows.
2. The windows of the other anchors are reported with hashes of two independent families, 96 bits, and the smallest doc_id of
   the block. That tells which recur, which document owns each, and which blocks have to look for it.
3. The owner's block turns the windows that others look for into passages: the owner's own words, as long as neighbouring
   windows are looked for by the same blocks. That is the table of recurring passages.
4. Each block compiles the windows of the passages that it has to look for into Aho-Corasick automata over numbered words,
   sharded to bounded size, and streams its documents through them. Words get their numbers by comparison, so what an automaton
   finds are equal words; a document loses the words of each occurrence whose owner comes before it. Hashes only
   choose which passages a block looks for: equal hashes of different words remove nothing.

Defined results: null and empty texts have no words; a null doc_id owns nothing and loses nothing; rows that share a
doc_id are one document for ownership; extra columns are ignored; an empty table gives no rows. Texts are searched whole,
and no window is left out.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import total_bytes
from .memory import of_group, of_groups
from .recurring import block_of, marked, of_several, several
from .words import Words, members

WINDOW = 13
ANCHOR = 5
#: Bytes of texts in one block.
BLOCK_BYTES = 4 << 20
#: Windows in one automaton.
SHARD = 32_000
#: Blocks that one row of a window names, as a power of two.
NAMED = 12

RESULT = "doc_id long, n_words long, n_removed long, kept string"
PASSAGES = "owner long, passage string, blocks array<long>"


class _Block:
    """The words of a block's documents, and its windows by the place of their first word."""

    def __init__(self, table: pa.Table, families: int = 1):
        self.texts = [text.encode() if text else b"" for text in table.column("text").to_pylist()]
        self.words = Words(self.texts, families)
        ids = table.column("doc_id").combine_chunks()
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        at = self.words.whole(WINDOW)
        self.at = at[named[self.words.text[at]]] if len(at) else at
        self.document = ids.fill_null(0).to_numpy()[self.words.text[self.at]]

    def anchors(self) -> np.ndarray:
        """The anchor of each window."""
        run = self.words.runs(ANCHOR)
        least = run.copy()
        for step in range(1, WINDOW - ANCHOR + 1):
            np.minimum(least[:-step], run[step:], out=least[:-step])
        return least[self.at]


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


def _report_anchors(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    block = _Block(table)
    anchor = block.anchors()
    new = np.ones(len(anchor), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (block.document[1:] != block.document[:-1])
    found, many = several(anchor[new], block.document[new])
    return pa.table({"anchor": _signed(found), "mark": marked(key[0].as_py(), many)})


def _report_windows(key: tuple[pa.Scalar, ...], docs: pa.Table, anchors: pa.Table) -> pa.Table:
    block = _Block(docs, families=2)
    known = np.sort(_unsigned(anchors.column("anchor")))
    use = members(block.anchors(), known) if len(block.at) else np.zeros(0, dtype=bool)
    at, document = block.at[use], block.document[use]
    one = block.words.runs(WINDOW)[at]
    two = (block.words.runs(WINDOW, family=1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    order = np.lexsort((document, two, one))
    one, two, document = one[order], two[order], document[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    start = np.flatnonzero(new)
    last = np.append(start, len(one))[1:] - 1
    mark = marked(key[0].as_py(), document[last] != document[start]).to_numpy()
    return pa.table({"one": _signed(one[start]), "two_mark": pa.array(two[start].astype(np.int64) << 32 | mark), "least": pa.array(document[start])})


def _passages(key: tuple[pa.Scalar, ...], docs: pa.Table, wanted: pa.Table) -> pa.Table:
    """The words of this block's documents that others look for, and the blocks that do."""
    block = _Block(docs)
    one, owner = _unsigned(wanted.column("one")), wanted.column("owner").to_numpy()
    lists = wanted.column("blocks").combine_chunks()
    cuts, named = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    size = np.diff(cuts)
    # Rows of one window and owner stand together; their lists are told apart by a sum.
    order = np.lexsort((owner, one))
    total = np.zeros(len(named) + 1, dtype=np.int64)
    np.cumsum((named + 1) * np.int64(0x5851F42D4C957F2D) ^ (named << np.int64(7)), out=total[1:])
    one, owner, sums = one[order], owner[order], (total[cuts[1:]] - total[cuts[:-1]])[order]
    new = np.ones(len(one), dtype=bool)
    new[1:] = (one[1:] != one[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    end = np.append(start, len(one))[1:]
    sums = np.add.reduceat(sums, start) if len(start) else sums
    # Windows of the block by hash and document, to find the rows that want them.
    own = block.words.runs(WINDOW)[block.at]
    use = np.flatnonzero(members(own, one[start])) if len(start) else np.zeros(0, dtype=np.int64)
    row = np.searchsorted(one[start], own[use])
    for _ in range(len(start)):
        ahead = (owner[start][row] != block.document[use]) & (row + 1 < len(start))
        ahead &= one[start][np.minimum(row + 1, len(start) - 1)] == own[use]
        if not ahead.any():
            break
        row = row + ahead
    right = owner[start][row] == block.document[use] if len(use) else np.zeros(0, dtype=bool)
    use, row = use[right], row[right]
    at, text = block.at[use], block.words.text[block.at[use]]
    breaks = np.ones(len(at), dtype=bool)
    breaks[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1]) | (sums[row[1:]] != sums[row[:-1]])
    first = np.flatnonzero(breaks)
    last = np.append(first, len(at))[1:] - 1
    passages, owners, blocks, split = [], [], [], (-1, [])
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        k = int(text[a])
        if split[0] != k:
            split = (k, block.texts[k].split())
        begin = int(block.words.first[k])
        passages.append(b" ".join(split[1][int(at[a]) - begin : int(at[b]) - begin + WINDOW]).decode())
        owners.append(int(block.document[use[a]]))
        rows = order[start[row[a]] : end[row[a]]]
        blocks.append(np.concatenate([named[cuts[r] : cuts[r] + size[r]] for r in rows.tolist()]))
    return pa.table({"owner": pa.array(owners, pa.int64()), "passage": pa.array(passages, pa.string()), "blocks": pa.array(blocks, pa.list_(pa.int64()))})


class _Letters:
    """Two letters for each word that passages hold, from alphabets of their own; equal words have equal letters.

    A node of an automaton looks through its children one by one, so an alphabet is the root of the number of words.
    """

    def __init__(self, passages: list[bytes]):
        self.number: dict[bytes, int] = {}
        for passage in passages:
            for word in passage.split():
                self.number.setdefault(word, len(self.number) + 1)
        self.base = int(len(self.number) ** 0.5) + 1

    def of(self, texts: list[bytes]) -> list[str]:
        """The letters of each text; words that no passage holds share a pair of their own. Empty where no window can match."""
        get = self.number.get
        split = [text.split() for text in texts]
        number = np.array([get(word, 0) for words in split for word in words], dtype=np.uint32)
        cuts = np.cumsum([0] + [len(words) for words in split])
        del split
        out = np.zeros(2 * len(number), dtype=np.uint32)
        known = number > 0
        out[0::2] = np.where(known, number // self.base + 1, 0)
        out[1::2] = np.where(known, number % self.base + self.base + 2, 0)
        letters = out.tobytes().decode("utf-32-le", "surrogatepass")
        # Windows of known words before each place, to see which texts hold one.
        sums = np.concatenate([[0], np.cumsum(known)])
        full = np.concatenate([[0], np.cumsum(sums[WINDOW:] - sums[:-WINDOW] == WINDOW)]) if len(number) >= WINDOW else np.zeros(1, dtype=np.int64)
        last = np.minimum(np.maximum(cuts[1:] - WINDOW + 1, cuts[:-1]), len(full) - 1)
        some = full[last] > full[np.minimum(cuts[:-1], len(full) - 1)]
        return [letters[2 * a : 2 * b] if any_ else "" for a, b, any_ in zip(cuts[:-1].tolist(), cuts[1:].tolist(), some.tolist(), strict=True)]


def _automata(letters: _Letters, passages: list[bytes], owners: list[int]) -> Iterator[ahocorasick.Automaton]:
    """Automata for the windows of passages: letters of a window -> its owner."""
    windows: dict[str, int] = {}
    for own, owner in zip(letters.of(passages), owners, strict=True):
        for end in range(2 * WINDOW, len(own) + 1, 2):
            window = own[end - 2 * WINDOW : end]
            if windows.setdefault(window, owner) > owner:
                windows[window] = owner
    # In order, so that an automaton has few first letters to try and shares the starts of windows.
    order = sorted(windows)
    for shard in range(0, len(order), SHARD):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for window in order[shard : shard + SHARD]:
            automaton.add_word(window, windows[window])
        automaton.make_automaton()
        yield automaton


def _remove(key: tuple[pa.Scalar, ...], docs: pa.Table, found: pa.Table) -> pa.Table:
    ids, texts = docs.column("doc_id").to_pylist(), [text.encode() if text else b"" for text in docs.column("text").to_pylist()]
    ends: dict[int, array] = {}
    if found.num_rows:
        passages = [passage.encode() for passage in found.column("passage").to_pylist()]
        letters = _Letters(passages)
        # One at a time: documents of the block, as letters, stay; automata come and go.
        streamed = [(k, document, own) for k, (document, own) in enumerate(zip(ids, letters.of(texts), strict=True)) if own and document is not None]
        for automaton in _automata(letters, passages, found.column("owner").to_pylist()):
            for k, document, own in streamed:
                here = [end // 2 for end, owner in automaton.iter(own) if owner < document]
                if here:
                    ends.setdefault(k, array("q")).extend(here)
        del streamed, letters
    n_words, n_removed, kept = [], [], []
    for k, text in enumerate(texts):
        row = text.split()
        n_words.append(len(row))
        if k in ends:
            last = np.array(ends.pop(k))
            change = np.zeros(len(row) + 1, dtype=np.int64)
            np.add.at(change, last + 1, -1)
            np.add.at(change, last - WINDOW + 1, 1)
            stays = np.cumsum(change[:-1]) == 0
            n_removed.append(int(len(row) - stays.sum()))
            row = list(compress(row, stays.tolist()))
        else:
            n_removed.append(0)
        kept.append(b" ".join(row).decode())
    return pa.table({
        "doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()),
        "n_removed": pa.array(n_removed, pa.int64()), "kept": pa.array(kept, pa.string()),
    })


def _wanted(reported: DataFrame) -> DataFrame:
    """(block of the owner, one, owner, blocks): windows that other documents hold, and the blocks of those."""
    # Dealt by one hash alone: two and the mark travel in one number.
    rows = reported.repartition("one").withColumn("two", F.shiftright("two_mark", 32).cast("int"))
    same = Window.partitionBy("one", "two")
    rows = rows.withColumn("mark", F.col("two_mark").bitwiseAND(F.lit((1 << 32) - 1))).drop("two_mark")
    rows = rows.select("one", "two", "least", "mark", F.min("least").over(same).alias("owner"), F.min_by("mark", "least").over(same).alias("first"))
    # A block whose only document with a window is the owner has nothing to remove.
    rows = rows.filter("owner < least OR mark % 2 = 1").select("one", "two", "owner", F.shiftright("first", 1).alias("block"), F.shiftright("mark", 1).alias("in"))
    lists = rows.groupBy("one", "two", "block", "owner", F.shiftright("in", NAMED).alias("part")).agg(F.sort_array(F.collect_list("in")).alias("blocks"))
    return lists.select("block", "one", "owner", "blocks")


def recurring_passages(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, text, block) dealt into blocks, and the passages (owner, passage, block) that each block looks for."""
    block = block_of(total_bytes(docs), F.col("doc_id"), F.octet_length("text"), block_bytes=block_bytes)
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", block.alias("block"))
    blocks = dealt.groupBy("block")
    anchors = of_several(blocks.applyInArrow(of_group(_report_anchors), "anchor long, mark long"), ["anchor"]).select("block", "anchor")
    reported = blocks.cogroup(anchors.groupBy("block")).applyInArrow(of_groups(_report_windows), "one long, two_mark long, least long")
    passages = blocks.cogroup(_wanted(reported).groupBy("block")).applyInArrow(of_groups(_passages), PASSAGES)
    return dealt, passages.select("owner", "passage", F.explode("blocks").alias("block"))


def remove_repeated(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Of documents (doc_id, text): doc_id, number of words, number of removed ones, and the kept words joined by one space."""
    ship(docs.sparkSession)
    dealt, passages = recurring_passages(docs, block_bytes)
    return dealt.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(of_groups(_remove), RESULT)
