"""Scanning a source tree into rows, and guarded reads of single files."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as X
from .shared_files import exists

TRUNCATED = "\n\n... [truncated] ..."


@F.pandas_udf(T.StringType())
def decode_utf8(content: pd.Series) -> pd.Series:
    """Bytes to text: invalid bytes are dropped and line ends become a single newline."""
    return content.map(
        lambda b: None if b is None else bytes(b).decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n")
    )


def _any_case(suffix: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _suffix_glob(suffixes) -> str:
    return "*{" + ",".join(_any_case(s) for s in suffixes) + "}"


def scan_tree(
    spark: SparkSession,
    root: str,
    mode: str = "base",
    roots=(".",),
    extra_roots=(),
    max_bytes: int | None = None,
) -> DataFrame:
    """path (relative to `root`), size_bytes, text of every file worth indexing under the scope roots.

    Only the folders of the scope are listed; file types are pruned while listing, and files of more than `max_bytes`, if
    that is given, by a pushed-down filter, before any content is read. When nothing worth indexing lies under the scope roots, the whole tree is taken.
    Extra roots outside the tree keep full paths.
    """
    base = root.rstrip("/")

    def listing(folders: list[str], prefix: str) -> DataFrame:
        raw = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", _suffix_glob(fv.CODE_SUFFIXES))
            .load(folders)
        )
        plain = F.regexp_replace("path", r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "/")
        relative = F.when(plain.startswith(prefix + "/"), F.substring(plain, len(prefix) + 2, 2**31 - 1)).otherwise(plain)
        return raw.select(relative.alias("path"), F.col("length").alias("size_bytes"), "content")

    def worth_indexing(folders: list[str], prefix: str) -> DataFrame:
        found = listing(folders, prefix)
        if max_bytes is not None:
            found = found.where(F.col("size_bytes") <= max_bytes)
        return found.where(P.should_index("path", "size_bytes", mode))

    top = posixpath.normpath(base)
    outer = [r for r in roots if not any(r != other and r.startswith(f"{other}/") for other in roots)]
    folders = [base] if "." in roots else [f"{base}/{r}" for r in outer if exists(spark, f"{base}/{r}")]
    scoped = worth_indexing(folders, top) if folders else None
    if scoped is None or folders != [base] and scoped.select("path").isEmpty():
        scoped = worth_indexing([base], top)
    for extra in extra_roots:
        more = worth_indexing([extra], "")
        scoped = scoped.unionByName(more).dropDuplicates(["path"])
    files = scoped.select("path", "size_bytes", decode_utf8("content").alias("text"))
    # A build file that declares a legacy module is only recognised by its content.
    return files.where(~P.is_legacy_path("path", F.col("text")))


@F.pandas_udf(T.StringType())
def _inside(paths: pd.Series, root: pd.Series) -> pd.Series:
    """Path relative to the root, or null when it points outside."""

    def resolve(path, base):
        if path is None:
            return None
        full = posixpath.normpath(posixpath.join(base, path))
        top = posixpath.normpath(base)
        if full == top or not full.startswith(top.rstrip("/") + "/"):
            return None
        return full[len(top.rstrip("/")) + 1:]

    return pd.Series([resolve(p, r) for p, r in zip(paths, root)])


def read_sources(requests: DataFrame, files: DataFrame, root: str = "/", max_chars: int | None = None, marker: bool = True) -> DataFrame:
    """`requests` (with `path`) plus `content`, the file's text (cut to `max_chars` if given), and `read_status`.

    A path outside the root is refused and a missing file gives an error text; the status is `ok`, `refused` or `missing`.
    Any doubt about a path refuses it.
    """
    asked = requests.withColumn("_key", _inside("path", F.lit(root)))
    found = asked.join(files.select(F.col("path").alias("_key"), "text"), "_key", "left")
    text = X.cut("text", max_chars, TRUNCATED if marker else "")
    status = F.when(F.col("_key").isNull(), "refused").when(F.col("text").isNull(), "missing").otherwise("ok")
    return found.withColumn("read_status", status).withColumn(
        "content",
        F.when(F.col("_key").isNull(), F.concat(F.lit("[refused: "), "path", F.lit(" is outside the source root]")))
        .when(F.col("text").isNull(), F.concat(F.lit("[error reading "), "path", F.lit(": no such file]")))
        .otherwise(text),
    ).drop("_key", "text")
