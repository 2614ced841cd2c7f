"""Passing rows through Python in Arrow batches, in pieces of bounded text size."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..batches import pieces, release


def with_columns(df: DataFrame, text: str, added: str, prepare: Callable[[], Callable[[list], list[pa.Array]]], most_bytes: int = 4 << 20) -> DataFrame:
    """The frame with columns computed from one text column; `added` is their DDL.

    `prepare` is called once per task and gives the function that maps a list of values to arrays; what it keeps goes
    with the task, as Python workers live on.
    """
    new = StructType.fromDDL(added)

    def run(batches):
        function = prepare()
        try:
            for batch in batches:
                for piece in pieces(batch, text, most_bytes):
                    arrays = function(piece.column(text).to_pylist())
                    yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=[*piece.schema.names, *new.names])
                    del arrays
                del batch, piece
                release()
        finally:
            del function
            release()

    return df.mapInArrow(run, StructType([*df.schema.fields, *new.fields]))
