"""Exact identifier search: which files hold any of a query's keywords, ignoring case.

All keywords of a batch are looked for in one pass over each text, in pieces of bounded size. A task keeps, per keyword, its
first k files in result order, and nothing else; the first k files of a query are always among the first k files of its
keywords, so nothing is lost.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..batches import pieces, release
from ..config import Limits
from ..functions import paths as P
from ..functions import text as X
from ..sizes import fits, small_side
from .topk import query_blocks

_MACHINES: dict = {}


def _matcher(key, patterns: list[str]):
    """text -> set of numbers of the patterns it holds. A worker keeps the automata of a few blocks."""
    if key not in _MACHINES:
        if len(_MACHINES) > 3:
            _MACHINES.clear()
        machine = _MACHINES[key] = ahocorasick.Automaton()
        for i, pattern in enumerate(patterns):
            machine.add_word(pattern, i)
        machine.make_automaton()
    machine = _MACHINES[key]
    return lambda text: {i for _, i in machine.iter(text)}


def matches(texts: DataFrame, patterns: DataFrame, keys: list[str], text: str, keep: int | None = None,
            limits: Limits = Limits()) -> DataFrame:
    """pattern, keys: one row per text and pattern it holds as a substring, compared as written.

    `patterns` has one column `pattern` without repeats. With `keep`, a task emits only its first `keep` rows per
    pattern in key order. Patterns come in blocks, all in one pass over the texts.
    """
    schema = T.StructType([T.StructField("pattern", T.StringType())] + [texts.schema[c] for c in keys])

    send = texts.sparkSession.sparkContext.broadcast
    blocks = [
        (uuid.uuid4().hex, send(sorted(r["pattern"] for r in rows)))
        for rows in query_blocks(patterns, limits.queries_per_slice * 16, "pattern")
    ]

    types = [to_arrow_type(field.dataType) for field in schema.fields]

    def scan(batches):
        first = _First(keep) if keep is not None else None
        for batch in batches:
            for piece in pieces(batch, text):
                for key, block in blocks:
                    words = block.value
                    found_in = _matcher(key, words)
                    rows, numbers = [], []
                    for row, one in enumerate(piece.column(text)):
                        found = found_in(one.as_py() or "")
                        rows.extend([row] * len(found))
                        numbers.extend(found)
                    if not rows:
                        continue
                    if first is None:
                        own = piece.select(keys).take(pa.array(rows, pa.int32()))
                        pattern = pa.array(words, pa.string()).take(pa.array(numbers, pa.int32()))
                        yield pa.RecordBatch.from_arrays([pattern, *own.columns], names=schema.names)
                    else:
                        first.add(piece.select(keys), words, rows, numbers)
            release()
        if first is not None and first.held:
            columns = zip(*((pattern, *row) for pattern, rows in first.held.items() for row in rows), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

    return texts.select(*keys, text).mapInArrow(scan, schema)


class _First:
    """The first `keep` rows of each pattern in key order; nulls come first."""

    def __init__(self, keep: int):
        self.keep = keep
        self.held: dict[str, list[tuple]] = {}

    def add(self, piece: pa.RecordBatch, words: list[str], rows: list[int], numbers: list[int]) -> None:
        keys = list(zip(*(column.to_pylist() for column in piece.columns), strict=True))
        order = sorted(range(len(keys)), key=lambda row: _in_order(keys[row]))
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        # Hits by pattern and then in key order; of each pattern the first ones of this piece.
        hits = np.sort(np.array(numbers, dtype=np.int64) * len(order) + rank[rows])
        number, place = hits // len(order), hits % len(order)
        starts = np.flatnonzero(np.diff(number, prepend=-1))
        for start, end in zip(starts.tolist(), np.append(starts[1:], len(hits)).tolist(), strict=True):
            held = self.held.setdefault(words[number[start]], [])
            found = [keys[order[p]] for p in place[start : min(end, start + self.keep)].tolist()]
            if len(held) < self.keep or found and _in_order(found[0]) < _in_order(held[-1]):
                held[:] = sorted(held + found, key=_in_order)[: self.keep]


def _in_order(row: tuple) -> tuple:
    return tuple((value is not None, value) for value in row)


def query_keywords(queries: DataFrame, max_keywords: int | None = None, query: str = "query") -> DataFrame:
    """query_id, keyword (lower case): the keywords of each query, with a number its strongest ones."""
    words = X.code_keywords(query)
    if max_keywords is not None:
        words = F.slice(words, 1, max_keywords)
    return queries.select("query_id", F.explode(words).alias("keyword")).select(
        "query_id", F.lower("keyword").alias("keyword")
    ).distinct()


def top_k(files: DataFrame, queries: DataFrame, k: int, roots, max_keywords: int | None = None, text: str = "text",
          limits: Limits = Limits(), carry: list[str] = ()) -> DataFrame:
    """query_id, path, rank, score: the first k files per query in (root, path) order, score 1 / rank.

    `files` has `path` and the text column; `carry` names further columns a path determines. Only file types and folders the channel covers are read.
    """
    searched = (
        files.where(P.searchable_by_exact("path") & P.under_roots("path", roots))
        .select(P.root_number("path", roots).alias("root_no"), "path", *carry, F.lower(text).alias("_text"))
    )
    words = query_keywords(queries, max_keywords)
    hits = matches(
        searched, words.select(F.col("keyword").alias("pattern")).distinct(), ["root_no", "path", *carry], "_text", k, limits
    )
    first = Window.partitionBy("pattern").orderBy("root_no", "path")
    per_word = hits.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    per_query = (
        per_word.join(small_side(words, fits(queries, limits)), F.col("pattern") == F.col("keyword"))
        .select("query_id", "root_no", "path", *carry)
        .distinct()
    )
    order = Window.partitionBy("query_id").orderBy("root_no", "path")
    return (
        per_query.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "path", *carry, "rank", (F.lit(1.0) / F.col("rank")).alias("score"))
    )
