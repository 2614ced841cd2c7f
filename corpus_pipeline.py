"""From raw documents to token ids, in five stages.

Each stage takes all documents that its predecessor kept and gives documents with their own columns; the last gives token
ids. Null texts are empty documents in every stage, and no stage drops a document for another reason than its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseek.llm import bpe, decontamination, ngram_join, toxicity
from sparkseek.llm.common import free_name, new_folder, table
from sparkseek.llm.exact_dedup import DigestIndex


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below a half. It learns from the labels of four fifths of the documents."""
    labels = table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    score = free_name(docs, "score")
    scored = toxicity.score(docs, toxicity.train(docs.select("doc_id", "text"), labels), added=score)
    return scored.filter(F.col(score) < 0.5).drop(score)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text the one with the smallest doc_id."""
    return DigestIndex(spark, new_folder(spark, "digest-index")).kept(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join the one with the smallest doc_id; documents that link with none stay. Documents link that
    share 80 % of their 5-word shingles; the 3 words and 90 % of op9 are that query's own."""
    return ngram_join.kept(docs, shingle=5, least=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of test items."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids, their number, and digests of the ids and of the bytes that they decode to."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.with_digests(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", exact_dedup),
    ("ngram_join", near_dedup),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]
#: The first stage is a trained classifier, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
