"""Labelled bugs in, evaluation results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_SCHEMA = (
    "id string, bug string, logcat string, gold_files array<string>, gold_diff_files array<string>, notes string"
)
ANSWER_SCHEMA = "id string, answer string, error string, verified_candidates array<string>, needs_human_review boolean"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one labelled bug each; blank lines are skipped."""
    return spark.read.schema(LABEL_SCHEMA).json(path).where(F.col("id").isNotNull())


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with the recorded answer of each bug: id, answer; where given, the error the run ended in, the candidates
    it verified, and whether a person has to look at it."""
    return spark.read.schema(ANSWER_SCHEMA).json(path).where(F.col("id").isNotNull())


def gold(labels: DataFrame, column: str = "gold_files") -> DataFrame:
    """query_id, path: gold files of each bug."""
    return labels.select(F.col("id").alias("query_id"), F.explode(column).alias("path"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """path, log: whole log files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("log"))


def write_results(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    """Rows and summary as JSON below a folder."""
    rows.write.mode("overwrite").json(f"{folder}/rows")
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")
