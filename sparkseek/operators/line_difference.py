"""Which lines two texts differ in: a shortest edit script, found by diagonals in linear space.

A step of the search lets one front advance from the start of both texts and one from their ends, each keeping only its
furthest place per diagonal; where they meet, the texts are split, and both parts are searched in the same way. Memory
is linear in the number of lines, time their number times that of the edits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The place on a diagonal that a front has left the texts on; behind all others.
OUTSIDE = -(1 << 62)
RANGES = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))


def _meeting(a: list[int], b: list[int]) -> tuple[int, int]:
    """A place (i, j) on a shortest way through a and b, which differ in their first and in their last elements."""
    n, m = len(a), len(b)
    shift, odd = n - m, (n - m) % 2
    ahead, back = {1: 0}, {1: 0}
    for edits in range((n + m + 1) // 2 + 1):
        for k in range(-edits, edits + 1, 2):
            i = ahead[k + 1] if k == -edits or (k != edits and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            while i < n and 0 <= i - k < m and a[i] == b[i - k]:
                i += 1
            ahead[k] = i = i if i <= n and i - k <= m else OUTSIDE
            if odd and abs(shift - k) < edits and i + back[shift - k] >= n:
                return i, i - k
        for k in range(-edits, edits + 1, 2):
            i = back[k + 1] if k == -edits or (k != edits and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            while i < n and 0 <= i - k < m and a[n - 1 - i] == b[m - 1 - i + k]:
                i += 1
            back[k] = i = i if i <= n and i - k <= m else OUTSIDE
            if not odd and abs(shift - k) <= edits and i + ahead[shift - k] >= n:
                return n - i, m - i + k
    raise AssertionError("two fronts always meet")


def inserted(old: list, new: list) -> list[int]:
    """Places in `new`, rising from 0, that a shortest edit script from `old` inserts."""
    numbers: dict = {}
    a, b = ([numbers.setdefault(one, len(numbers)) for one in side] for side in (old, new))
    found, parts = [], [(0, len(a), 0, len(b))]
    while parts:
        a0, a1, b0, b1 = parts.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            found += range(b0, b1)
            continue
        i, j = _meeting(a[a0:a1], b[b0:b1])
        parts += [(a0 + i, a1, b0 + j, b1), (a0, a0 + i, b0, b0 + j)]
    return found


def changed_ranges(old: str, new: str) -> list[tuple[int, int]]:
    """Inclusive ranges of lines of `new`, from 1, that were added or changed."""
    ranges: list[tuple[int, int]] = []
    for place in inserted(old.splitlines(), new.splitlines()):
        if ranges and ranges[-1][1] == place:
            ranges[-1] = (ranges[-1][0], place + 1)
        else:
            ranges.append((place + 1, place + 1))
    return ranges


@F.pandas_udf(RANGES)
def changed_ranges_udf(olds: pd.Series, news: pd.Series) -> pd.Series:
    """Ranges of changed lines; null where either text is null."""
    found = [None if o is None or n is None else changed_ranges(o, n) for o, n in zip(olds, news)]
    return pd.Series([None if one is None else [{"first": a, "last": b} for a, b in one] for one in found])
