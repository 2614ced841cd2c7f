"""Arrow batches of bounded size, their pieces of bounded text size, and giving memory back between them.

A batch holds as many rows and bytes as the session says, by Spark's default up to 10,000 rows and 64 MB, and a worker has
the batch it works on and the next one in memory. `bound_batches` makes both small. Where a session keeps larger ones, Python
code that looks at texts takes a batch piece by piece.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

#: Text bytes of a piece, about.
PIECE_BYTES = 4 << 20
#: Bytes of a batch, about.
BATCH_BYTES = 4 << 20

_BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None


def bound_batches(spark: SparkSession) -> None:
    """Let the session hand Python workers batches of about BATCH_BYTES, unless it names a size of its own."""
    if spark.conf.get(_BATCH_BOUND, None) is None:
        spark.conf.set(_BATCH_BOUND, str(BATCH_BYTES))


def release() -> None:
    """Hand freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `most_bytes` of a text column each, and one row at least."""
    start = size = 0
    for row, length in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if size and size + length > most_bytes:
            yield batch.slice(start, row - start)
            start = row
            size = 0
        size += length
    if start < batch.num_rows:
        yield batch.slice(start)


def row_by_row(function: Callable, kind: pa.DataType, text: pa.Array, *others: pa.Array) -> pa.Array:
    """The function's value for each row of a text column and others; Python holds texts and values of one piece at a time."""
    names = [str(number) for number in range(1 + len(others))]
    done = [
        pa.array([function(*(value.as_py() for value in row)) for row in zip(*piece.columns, strict=True)], kind)
        for piece in pieces(pa.RecordBatch.from_arrays([text, *others], names=names), "0")
    ]
    release()
    return pa.concat_arrays(done) if done else pa.array([], kind)
