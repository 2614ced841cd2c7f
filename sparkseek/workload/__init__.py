"""Queries over the driver's tables, each paired with the SQL a second engine can check it with.

The tables hold prose, not source code. `data.source_tree` lays the documents out as a virtual source tree, one file
per document, so that path rules, tiers, layers and tenants all have something to work on. Results exercise what the
operators compute; they say nothing about real source trees.
"""

from . import chunks, diagnosis, diffs, evaluation, files, index, retrieval, votes  # noqa: F401  (register queries)
from .registry import oracle_sql, queries

__all__ = ["queries", "oracle_sql"]
