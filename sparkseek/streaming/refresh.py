"""Incremental indexing driven by a stream of changes."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..config import Settings
from ..plans.indexing import refresh_store


def refresh_on_changes(changes: DataFrame, files: Callable[[], DataFrame], folder: str, mode: str,
                       settings: Settings = Settings(), embed=None) -> DataStreamWriter:
    """A writer that refreshes the store once per micro-batch of change records (path, status).

    `files` gives the present state of the tree. A batch that is delivered twice re-cuts the same files and leaves the
    same chunks, so a restarted stream does no harm.
    """

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh_store(files(), folder, mode, settings, batch.select("path", "status"), embed=embed)

    return changes.writeStream.foreachBatch(apply)
