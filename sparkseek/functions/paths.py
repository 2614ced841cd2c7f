"""Column expressions over file paths: index filters, layer tags, scope tests and path normalisation.

A rule tests many markers against one normalised path. The path is normalised once and bound to a variable; the tests
on it are plain substring comparisons. Rules need no file content and can be evaluated before any is read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, through a one-element array."""
    return F.transform(F.array(value), body)[0]


def any_of(conditions) -> Column:
    """OR over a list of conditions; false when the list is empty."""
    return reduce(or_, conditions, F.lit(False))


def contains_any(column, parts) -> Column:
    """Whether the text holds any of the parts."""
    return any_of([F.contains(_col(column), F.lit(p)) for p in parts])


def ends_with_any(column, endings) -> Column:
    return any_of([F.endswith(_col(column), F.lit(e)) for e in endings])


def _holds(p: Column, parts=(), endings=()) -> Column:
    """A marker with a leading slash also matches at the root of a relative path."""
    at_root = [F.startswith(p, F.lit(m[1:])) for m in parts if m.startswith("/")]
    return contains_any(p, parts) | any_of(at_root) | ends_with_any(p, endings)


def path_matches(path, parts=(), endings=()) -> Column:
    """Whether a path, ignoring case and slash direction, holds a part or ends in an ending."""
    return bound(lowered(path), lambda p: _holds(p, parts, endings))


def slashed(path) -> Column:
    """The path with forward slashes only."""
    return F.translate(_col(path), "\\", "/")


def lowered(path) -> Column:
    return F.lower(slashed(path))


def file_name(path) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def _suffix_of(name: Column) -> Column:
    last = F.substring_index(name, ".", -1)
    return F.when((last != "") & (F.length(last) < F.length(name) - 1), F.concat(F.lit("."), last)).otherwise(F.lit(""))


def suffix(path) -> Column:
    """Lower-cased file suffix with its dot; empty for names without one and for dot files."""
    return F.lower(_suffix_of(file_name(path)))


def stem(path) -> Column:
    """File name without its last suffix, case kept."""
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(_suffix_of(name)))


def is_legacy_path(path, content=None) -> Column:
    """Legacy-interface file: by marker, by suffix, or by the module declared in a build file."""
    legacy = path_matches(path, fv.LEGACY_MARKERS, (".hal",))
    if content is not None:
        declares = F.coalesce(F.contains(_col(content), F.lit("hidl_interface")), F.lit(False))
        legacy = legacy | (path_matches(path, endings=(".bp",)) & declares)
    return legacy


def is_policy_path(path) -> Column:
    """Access-control policy file."""
    return path_matches(path, fv.POLICY_MARKERS, (".te", ".cil"))


def guess_layer(path) -> Column:
    """Layer tag of a path: the first rule that holds, in the fixed order."""

    def tag(p: Column) -> Column:
        layers = None
        for layer, parts, endings in fv.LAYER_RULES:
            rule = _holds(p, parts, endings)
            layers = F.when(rule, layer) if layers is None else layers.when(rule, layer)
        return layers.otherwise(fv.DEFAULT_LAYER)

    return bound(lowered(path), tag)


def _has_segment(path, segments) -> Column:
    return F.arrays_overlap(F.split(lowered(path), "/"), F.array(*[F.lit(s) for s in segments]))


def should_index(path, size_bytes, mode: str = "base", content=None, max_bytes: int | None = None) -> Column:
    """Whether a file goes into the index. Paths are taken relative to the scanned root; `max_bytes`, if given, bounds the size."""
    if mode not in ("base", "customer"):
        raise ValueError(f"unknown index mode {mode!r}")
    keep = (
        suffix(path).isin(*fv.CODE_SUFFIXES)
        & ~is_legacy_path(path, content)
        & ~_has_segment(path, fv.BASE_EXCLUDED_SEGMENTS if mode == "base" else fv.CUSTOMER_EXCLUDED_SEGMENTS)
    )
    if max_bytes is not None:
        keep = keep & (_col(size_bytes) <= max_bytes)
    if mode == "base":
        keep = keep & ~path_matches(path, fv.BASE_EXCLUDED_PARTS, fv.BASE_EXCLUDED_ENDINGS)
    return keep


def under_roots(path, roots) -> Column:
    """Whether the path equals or lies below one of the roots; '.' stands for the whole tree."""
    names = [r.replace("\\", "/").strip("/") for r in roots]
    if any(n in (".", "") for n in names):
        return _col(path).isNotNull()
    if not names:
        return F.lit(False)
    return slashed(path).rlike(r"\A/*(?:" + "|".join(re.escape(n) for n in names) + r")(?:/|\z)")


def root_number(path, roots) -> Column:
    """Position of the first root a path lies under, null when there is none."""
    number = None
    for i, root in enumerate(roots):
        rule = under_roots(path, [root])
        number = F.when(rule, F.lit(i)) if number is None else number.when(rule, F.lit(i))
    return number if number is not None else F.lit(None).cast("int")


def norm_path(path) -> Column:
    """Path for gold comparison: forward slashes, trimmed, without leading dots and slashes, lower case."""
    p = F.regexp_replace(slashed(path), r"(?U)^\s+|\s+$", "")
    return F.lower(F.regexp_replace(p, r"^[./]+", ""))


def searchable_by_exact(path) -> Column:
    """Files the exact-identifier channel looks into."""
    skipped = [f"/{d}/" for d in fv.EXACT_SKIPPED_DIRS]
    return suffix(path).isin(*fv.EXACT_SUFFIXES) & ~path_matches(path, skipped)
