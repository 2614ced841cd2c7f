"""What changed between two states of a tree."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def snapshot(files: DataFrame, text: str = "text") -> DataFrame:
    """path, digest."""
    return files.select("path", F.sha2(F.col(text), 256).alias("digest"))


def snapshot_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, status (A added, M modified, D deleted) between two snapshots; a rename is a D and an A."""
    o = old.select("path", F.col("digest").alias("_old"))
    n = new.select("path", F.col("digest").alias("_new"))
    status = F.when(F.col("_old").isNull(), "A").when(F.col("_new").isNull(), "D").otherwise("M")
    return (
        o.join(n, "path", "full_outer")
        .where(~F.col("_old").eqNullSafe(F.col("_new")))
        .select("path", status.alias("status"))
    )


def git_head(root: str) -> str | None:
    """Commit id of a checkout, or none."""
    try:
        run = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.strip() or None


def parse_name_status(lines: DataFrame, line: str = "value") -> DataFrame:
    """path, status from `git diff --name-status` lines; a rename deletes its old path and adds the new one."""
    parts = F.split(line, "\t")
    kind = F.substring(parts[0], 1, 1)
    one = F.array(F.struct(F.element_at(parts, -1).alias("path"), F.when(kind.isin("A", "D"), kind).otherwise(F.lit("M")).alias("status")))
    two = F.array(
        F.struct(parts[1].alias("path"), F.lit("D").alias("status")),
        F.struct(F.element_at(parts, -1).alias("path"), F.lit("A").alias("status")),
    )
    rows = F.when((kind == "R") & (F.size(parts) > 2), two).otherwise(one)
    return lines.where(F.size(parts) >= 2).select(F.explode(rows).alias("_r")).select("_r.path", "_r.status")


def git_changes(spark: SparkSession, root: str, old: str, new: str) -> DataFrame | None:
    """Changes between two commits of a checkout, or none when git cannot tell."""
    try:
        run = subprocess.run(
            ["git", "-C", root, "diff", "--name-status", old, new], capture_output=True, text=True, timeout=60
        )
    except (OSError, subprocess.TimeoutExpired):
        return None
    if run.returncode != 0:
        return None
    schema = T.StructType([T.StructField("value", T.StringType())])
    return parse_name_status(spark.createDataFrame([(l,) for l in run.stdout.splitlines()], schema))
