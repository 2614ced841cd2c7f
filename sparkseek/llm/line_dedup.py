"""Line dedup: globally repeated chunks of several lines are removed; each chunk stays where it first occurs.

A text is cut into lines, and the lines into chunks by their content: over the hashes of the last lines rolls a cyclic
polynomial, and where its low bits are zero a chunk ends. An inserted or removed line shifts nothing beyond the next few
boundaries. A text may be cut by several rules at once, since a short run of lines in the middle of a text is one chunk
only if boundaries happen to enclose it. Chunks are grouped by the hashes of their lines, map side first, so a chunk that a
third of all documents hold is one row per task. The bytes are compared line by line: every distinct line of the corpus is
grouped by itself, once for all cuts, and where a hash stands for one line only, equal hashes are equal lines. Chunks with a
line whose hash several lines share, or that share their own hash, are compared by their whole bytes. Everything is
column expressions and joins.

A chunk occurs first in the document with the smallest doc_id, there at its first place; the other places lose it, but
for those that overlap that first place. With several rules a line goes if a chunk of any rule takes it: every removed
line is also in an earlier place, so no line is lost, although a chunk's first place may lose lines to a chunk of another
rule. Chunks of one line, and those of blank lines alone, stay.

Defined results: a null text counts as empty, one empty line; a null doc_id sorts behind all others; equal rows are told
apart by their place in the table; empty tables give no rows; extra columns pass through; texts are cut whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, numbered_rows, written

#: Lines under the rolling hash, and the mask of its bits that are zero at a boundary (one in four lines).
ROLLING = 3
MASK = 3


class Cut(NamedTuple):
    """Where chunks end: where the masked bits of the hash over `rolling` lines equal `value`. With `pairs`, no chunk of a text of several lines has a single line: of boundaries at adjacent lines
    every second one counts, and the first and the last line join their neighbours."""

    rolling: int = ROLLING
    mask: int = MASK
    pairs: bool = False
    value: int = 0


#: The cuts of op1: a hash rolls over two lines, and either value of its lowest bit gives boundaries; chunks have two lines
#: and more, three on average.
FINE = (Cut(2, 1, True, 0), Cut(2, 1, True, 1))


def _rotated(value: Column, by: int) -> Column:
    return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once per row, although lambdas behind them use them for each element."""
    return df.select("*", F.inline(F.array(F.struct(*[column.alias(name) for name, column in columns.items()]))))


def with_rows(docs: DataFrame) -> DataFrame:
    """(own, row): each document as a struct of its columns, and a number; written."""
    return numbered_rows(docs.select(F.struct("*").alias("own")))


def with_chunks(rows: DataFrame, cuts: Sequence[Cut] = (Cut(),)) -> DataFrame:
    """Rows with doc, lines, hashes (of the lines) and chunks added; chunks: first line (from 1) and number of lines of each chunk of any cut."""
    keep = rows.columns
    doc = F.coalesce(F.col("own.doc_id").cast("long"), F.lit((1 << 63) - 1))
    rows = rows.withColumn("doc", doc).withColumn("text", F.coalesce("own.text", F.lit("")))
    rows = _held(rows, lines=F.split("text", "\n")).drop("text")
    rows = _held(rows, hashes=F.transform("lines", lambda line: F.xxhash64(line)))
    rows = rows.withColumn("chunks", F.array().cast("array<struct<first:int,n:int>>"))
    for cut in cuts:
        rows = _cut_once(rows, cut)
    return rows.select(*keep, "doc", "lines", "hashes", "chunks")


def _cut_once(rows: DataFrame, cut: Cut) -> DataFrame:
    """The chunks of one cut, added to those that are there."""

    def rolling(place: Column) -> Column:
        value = F.element_at("hashes", place)
        for back in range(1, cut.rolling):
            earlier = F.when(place > back, F.element_at("hashes", F.greatest(place - back, F.lit(1)))).otherwise(F.lit(0))
            value = value.bitwiseXOR(_rotated(earlier, back))
        return value

    count = F.size("lines")
    places = F.sequence(F.lit(1), count)
    ends_at = lambda place: rolling(place).bitwiseAND(F.lit(cut.mask)) == cut.value
    if cut.pairs:
        inside = lambda place: (place > 1) & (place < count - 1)
        marks = F.array_join(F.transform(places, lambda place: F.when(inside(place) & ends_at(place), "1").otherwise("0")), "")
        # From left to right, the second of two boundaries goes.
        rows = _held(rows, marks=F.split(F.replace(marks, F.lit("11"), F.lit("10")), ""))
        ends_at = lambda place: F.element_at("marks", place) == "1"
    rows = _held(rows, ends=F.filter(places, lambda place: (place == count) | ends_at(place)))
    first = lambda k: F.when(k == 0, F.lit(1)).otherwise(F.element_at("ends", F.greatest(k, F.lit(1))) + 1)
    chunks = F.transform("ends", lambda end, k: F.struct(first(k).alias("first"), (end - first(k) + 1).alias("n")))
    return _held(rows.withColumnRenamed("chunks", "known"), chunks=F.array_union("known", chunks)).drop("known", "marks", "ends")


def _chunk_rows(chunked: DataFrame) -> DataFrame:
    """(row, doc, first, n, key, hash) of the chunks that may go; key: the hashes of a chunk's lines, in order."""
    shown = lambda line: F.trim(F.translate(line, "\r\t", "")) != ""
    one = lambda chunk: F.struct(
        chunk["first"].alias("first"), chunk["n"].alias("n"), F.slice("hashes", chunk["first"], chunk["n"]).alias("key"),
        F.exists(F.slice("lines", chunk["first"], chunk["n"]), shown).alias("shown"),
    )
    long = F.filter("chunks", lambda chunk: chunk["n"] > 1)
    each = chunked.select("row", "doc", F.inline(F.transform(long, one))).filter("shown").drop("shown")
    return each.withColumn("hash", F.xxhash64("key"))


def _line_collisions(rows: DataFrame) -> DataFrame:
    """(line) the hashes that several lines share. Grouping by the line itself compares bytes; each task sends a line once."""
    text = F.coalesce("own.text", F.lit(""))
    lines = rows.filter(F.contains(text, F.lit("\n"))).select(F.explode(F.split(text, "\n")).alias("bytes"))
    lines = lines.select(F.xxhash64("bytes").alias("line"), "bytes").groupBy("line", "bytes").agg(F.lit(1).alias("one"))
    return lines.groupBy("line").agg(F.count("one").alias("lines")).filter("lines > 1").select("line")


def _with_bytes(chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """Chunk places with the text of each chunk, as bytes to compare."""
    lines = F.slice(F.split(F.coalesce("own.text", F.lit("")), "\n"), F.col("first"), F.col("n"))
    return chunks.join(rows, "row").select(*chunks.columns, F.array_join(lines, "\n").alias("bytes"))


def repeated_chunks(rows: DataFrame, cuts: Sequence[Cut] = (Cut(),)) -> DataFrame:
    """(row, first, n) of the chunks to remove; rows as with_rows gives them."""
    chunks = written(_chunk_rows(with_chunks(rows, cuts)), "chunk-places")
    keys = chunks.groupBy("hash", "key").agg(F.min("doc").alias("first_doc"), F.count("*").alias("size"))
    hashes = keys.groupBy("hash").agg(
        F.count("*").alias("keys"), F.sum("size").alias("size"), F.min("first_doc").alias("first_doc"), F.first("key").alias("key"),
    ).filter("size > 1")
    hashes = written(hashes, "chunk-hashes")
    total = hashes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # Chunks with equal hashes are equal unless the hash of a chunk or of one of its lines stands for several: those few are
    # compared by their own bytes below.
    shared_lines = written(_line_collisions(rows), "line-collisions")
    lines = hashes.select("hash", F.explode("key").alias("line"))
    by_line = lines.join(shared_lines, "line", "left_semi").select("hash")
    collisions = written(hashes.filter("keys > 1").select("hash").unionByName(by_line).distinct(), "chunk-collisions")
    plain = hashes.join(collisions, "hash", "left_anti").select("hash", "size", "first_doc")

    places = chunks.drop("key")
    plain = join_groups(places, plain, "hash", "size", total).select("hash", "row", "doc", "first", "n", "first_doc")
    stays = plain.filter(F.col("doc") == F.col("first_doc")).groupBy("hash").agg(F.min(F.struct("row", "first")).alias("stay"))
    elsewhere = plain.filter(F.col("doc") != F.col("first_doc")).select("row", "first", "n")
    own = plain.filter(F.col("doc") == F.col("first_doc")).join(stays, "hash").filter(_behind()).select("row", "first", "n")

    # Written first, so Spark knows how few they are and doesn't shuffle the texts to find them.
    shared = _with_bytes(written(places.join(collisions, "hash", "left_semi"), "collided-places"), rows)
    first = shared.groupBy("hash", "bytes").agg(F.min(F.struct("doc", "row", "first")).alias("stay"))
    collided = shared.join(first, ["hash", "bytes"]).filter(_behind()).select("row", "first", "n")
    return elsewhere.unionByName(own).unionByName(collided)


def _behind() -> Column:
    """Whether a place of a chunk neither is the one that stays nor overlaps it."""
    return (F.col("row") != F.col("stay.row")) | (F.col("first") >= F.col("stay.first") + F.col("n"))


def remove_repeated(
    docs: DataFrame, text: str = "deduplicated", n_lines: str = "n_lines", n_removed: str = "n_removed", cut: Cut | Sequence[Cut] = Cut()
) -> DataFrame:
    """The documents with the text that is left, the number of lines, and that of removed lines, under a cut or several."""
    cuts = (cut,) if isinstance(cut, Cut) else tuple(cut)
    rows = with_rows(docs)
    gone = repeated_chunks(rows, cuts).groupBy("row").agg(F.collect_set(F.struct("first", "n")).alias("gone"))
    found = rows.join(gone, "row", "left").withColumn("lines", F.split(F.coalesce("own.text", F.lit("")), "\n"))
    covered = F.flatten(F.transform("gone", lambda chunk: F.sequence(chunk["first"], chunk["first"] + chunk["n"] - 1)))
    places = F.sequence(F.lit(1), F.size("lines"))
    found = _held(found, left=F.when(F.col("gone").isNull(), places).otherwise(F.array_except(places, covered)))
    found = _held(found, kept=F.transform("left", lambda place: F.element_at("lines", place)))
    return found.select(
        "own.*", F.array_join("kept", "\n").alias(text), F.size("lines").cast("long").alias(n_lines),
        (F.size("lines") - F.size("kept")).cast("long").alias(n_removed),
    )
