"""Giving memory back between the pieces of work of one Python worker.

Workers live on from task to task and from stage to stage, and the allocators below numpy and Arrow keep what was freed. On
executors with a fixed share of memory for Python, that would add up to the largest piece of every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

from ..batches import release


def of_group(function: Callable[..., pa.Table]) -> Callable[[tuple, pa.Table], pa.Table]:
    """A function of a group's key and table that gives memory back before it is called."""

    def run(key, table):
        release()
        return function(key, table)

    return run


def of_groups(function: Callable[..., pa.Table]) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """The same for a key and two tables."""

    def run(key, one, two):
        release()
        return function(key, one, two)

    return run
