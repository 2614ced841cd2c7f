"""Every stage of the pipeline against brute force on its own input."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import public_tokenizers
import tiktoken

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline
from pyspark.sql import functions as F
from sparkseek.llm import bpe, ngram_join, toxicity, workload

from .test_dedup import normalised
from .test_text import brute_items

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("row", F.lit(1))
    inputs = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        inputs[name] = docs
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == inputs[name].columns
    rows = {name: {row.doc_id: row.text for row in frame.collect()} for name, frame in inputs.items()}
    out = {row.doc_id: row for row in docs.collect()}

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    scored = toxicity.score(inputs["toxicity"], toxicity.train(inputs["toxicity"], labels)).collect()
    assert set(rows["exact_dedup"]) == {row.doc_id for row in scored if row.score < 0.5}

    groups = defaultdict(list)
    for doc_id, text in rows["exact_dedup"].items():
        groups[normalised(text)].append(doc_id)
    assert set(rows["ngram_join"]) == {min(own) for own in groups.values()}

    assert set(rows["decontamination"]) == brute_kept(list(rows["ngram_join"].items()), 5, 80)

    items = [tuple(row) for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    for doc_id, text in rows["decontamination"].items():
        n, hit, _ = brute_items(text, items)
        assert (doc_id in rows["byte_bpe"]) == (not (hit and 20 * hit >= n))

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert set(out) == set(rows["byte_bpe"])
    for doc_id, text in rows["byte_bpe"].items():
        assert out[doc_id].ids == library.encode_ordinary(text)
        assert out[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_stages_take_empty_and_null_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for k, rows in enumerate(([], [(None, None, None, None, None)] * 2 + [(1, None, None, None, None), (2, "", "en", "s", 0)])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{k}-{name}")
            stage(spark, docs, FOLDER).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() == (1 if rows else 0)


def test_toxicity_is_learned(spark):
    found = workload.queries()["op5_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = found.join(labels, "doc_id").filter("held_out").collect()
    assert sum(row.predicted == row.toxic for row in held) / len(held) > 0.93


def brute_kept(rows, shingle, least):
    """The smallest doc_id of each class."""
    sets = []
    for _, text in rows:
        words = text.lower().split()
        sets.append({tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))})
    above = list(range(len(rows)))

    def root(k):
        while above[k] != k:
            k = above[k]
        return k

    for i, own in enumerate(sets):
        for j in range(i):
            if 100 * len(own & sets[j]) >= least * len(own | sets[j]):
                above[root(i)] = root(j)
    return {min(rows[j][0] for j in range(len(rows)) if root(j) == k) for k in range(len(rows)) if above[k] == k}


def test_near_stage_links_at_five_words_and_four_fifths(spark):
    pick = random.Random(6)
    rows = []
    for k in range(30):
        base = [f"w{pick.randrange(5000)}" for _ in range(200)]
        edited = list(base)
        for _ in range(k % 7):  # some are links at 3 words and 0.9, some only at 5 and 0.8, some not at all
            edited[pick.randrange(200)] = f"x{pick.randrange(5000)}"
        longer = base[:90] + [f"y{pick.randrange(5000)}" for _ in range(10 + k)] + base[90:]
        rows += [(10 * k, " ".join(base)), (10 * k + 1, " ".join(edited)), (10 * k + 2, " ".join(longer))]
    rows += [(1000 + k, "a b c d e f g"[: 2 * k + 1]) for k in range(7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {row.doc_id for row in corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()}
    assert got == brute_kept(rows, 5, 80)
    assert len(brute_kept(rows, 3, 90)) - len(got) > 10
    for shingle, least in ((1, 50), (2, 5), (4, 100)):
        got = {row.doc_id for row in ngram_join.kept(docs, shingle=shingle, least=least).collect()}
        assert got == brute_kept(rows, shingle, least)
