"""The inverted index: equal to scoring everything, reads only what is asked, skips slices that can't win."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek.config import Bm25, Limits
from sparkseek.operators import bm25, postings

from test_retrieval import okapi


def corpus(n, seed):
    pick = random.Random(seed)
    words = [f"w{k}" for k in range(60)]
    texts = {f"d{k:04}": " ".join(pick.choices(words, weights=[1 / (1 + r) for r in range(60)], k=pick.randint(0, 40))) for k in range(n)}
    for k in range(0, n, 3):  # a third of all rows are copies, spread over all slices
        texts[f"d{k:04}"] = "w3 w5 w7 w7"
    return texts


def stored(spark, texts, path, monkeypatch, bits=4):
    monkeypatch.setattr(postings, "SLICE_BITS", bits)
    docs = spark.createDataFrame([("base", d, t) for d, t in texts.items()], "store string, doc_id string, text string").repartition(3)
    documents = postings.written(postings.placed(bm25.counted(docs, ["doc_id"], "text"), ["store", "doc_id"]), "documents")
    postings.write(postings.postings(documents), path)
    index = spark.read.parquet(path)
    vocabulary = postings.vocabulary(index)
    stats = bm25.collection_stats(documents, vocabulary)
    return index, documents, vocabulary, stats


@pytest.mark.parametrize("limits", [Limits(), Limits(weights_per_block=4)])
def test_index_equals_brute_force_with_ties_over_slices(spark, tmp_path, monkeypatch, limits):
    texts = corpus(300, 1)
    index, documents, vocabulary, stats = stored(spark, texts, str(tmp_path / "p"), monkeypatch)
    assert documents.groupBy("_slice").count().agg(F.max("count")).first()[0] <= 16
    queries = {1: "w3 w7", 2: "w0 w1 w2", 3: "w59 w5", 4: "nowhere", 5: "w7 w7 w58"}
    frame = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    weights = bm25.term_weights(bm25.with_idf(vocabulary, stats), frame, True)
    hits = postings.top_k(index, documents, weights, stats, 7, ["doc_id"], limits=limits).collect()
    for q, text in queries.items():
        got = [(h.doc_id, round(h.score, 6)) for h in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)]
        assert got == [(d, round(s, 6)) for d, s in okapi(texts, text)[:7]]


def test_counts_come_from_the_sizes(spark, tmp_path, monkeypatch):
    texts = corpus(100, 2)
    index, documents, vocabulary, _ = stored(spark, texts, str(tmp_path / "p"), monkeypatch)
    assert sorted(vocabulary.collect()) == sorted(bm25.vocabulary(documents).collect())
    for row in index.collect():
        assert row.n == len(row.docs) <= 16 and row.most == max(row.tfs) and row.least == min(row.dls) and row.docs == sorted(row.docs)


def test_only_folders_of_asked_terms_are_read(spark, tmp_path, monkeypatch):
    index, documents, vocabulary, stats = stored(spark, corpus(100, 3), str(tmp_path / "p"), monkeypatch)
    queries = spark.createDataFrame([(1, "w7")], "query_id int, query string")
    weights = bm25.term_weights(bm25.with_idf(vocabulary, stats), queries, True)
    hits = postings.top_k(index, documents, weights, stats, 3, ["doc_id"])
    plan = hits._jdf.queryExecution().executedPlan().toString()
    bucket = index.where("term = 'w7'").first().bucket
    assert re.search(rf"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = {bucket}\)\]", plan)
    # Without the other folders the answer is the same.
    only = spark.read.option("basePath", str(tmp_path / "p")).parquet(str(tmp_path / "p" / f"bucket={bucket}"))
    again = postings.top_k(only, documents, weights, stats, 3, ["doc_id"])
    assert sorted(hits.collect()) == sorted(again.collect())


def test_slices_that_cannot_win_are_left_out():
    queries = postings._Queries([{"query_id": 1, "term": "rare", "w": 5.0}, {"query_id": 1, "term": "the", "w": 0.1}, {"query_id": 2, "term": "the", "w": 0.1}])

    class Block:
        value = {"base": queries}

    def rows(number, term, n):
        return {"store": "base", "_slice": number, "term": term, "most": 1, "least": 10, "docs": list(range(n)), "tfs": [1] * n, "dls": [10] * n}

    frames = [rows(0, "rare", 3), rows(0, "the", 8)] + [rows(k, "the", 8) for k in range(1, 50)]
    table = pa.Table.from_pylist(frames, pa.schema([("store", pa.string()), ("_slice", pa.int64()), ("term", pa.string()), ("most", pa.int32()), ("least", pa.int32()),
                                                    *[(name, pa.list_(pa.int32())) for name in postings.LISTS]]))
    scored = []
    add = postings._Best.add
    try:
        postings._Best.add = lambda self, queries, scores, number: (scored.append((number, queries.tolist())), add(self, queries, scores, number))
        out = list(postings._scan(Block, {"base": 10.0}, 3, Bm25(), pa.int64())(iter(table.to_batches(max_chunksize=7))))
    finally:
        postings._Best.add = add
    assert [queries for number, queries in scored if number] and all(queries == [1] for number, queries in scored if number)
    best = pa.Table.from_batches(out).to_pylist()
    assert {(r["_slice"], r["_doc"]) for r in best if r["query_id"] == 1} == {(0, 0), (0, 1), (0, 2)}
    assert np.isclose([r["score"] for r in best if r["query_id"] == 2], 0.1).all()


def test_scores_of_many_queries_are_in_memory_in_parts(spark, tmp_path, monkeypatch):
    texts = corpus(120, 4)
    index, documents, vocabulary, stats = stored(spark, texts, str(tmp_path / "p"), monkeypatch)
    queries = [{"query_id": q, "term": f"w{q}", "w": 1.0} for q in range(9)]
    rows = index.where(F.col("term").isin([q["term"] for q in queries])).withColumn("store", F.lit("base")).orderBy("_slice", "term")
    batches = rows.select("store", "_slice", "term", "most", "least", *postings.LISTS).toArrow().to_batches()

    class Block:
        value = {"base": postings._Queries(queries)}

    def found(size):
        widths = []
        add = postings._Best.add
        with monkeypatch.context() as patch:
            patch.setattr(postings, "SCORED_QUERIES", size, raising=False)
            patch.setattr(postings._Best, "add", lambda self, queries, scores, number: (widths.append(scores.shape[1]), add(self, queries, scores, number)))
            out = pa.Table.from_batches(list(postings._scan(Block, {"base": 10.0}, 3, Bm25(), pa.int64())(iter(batches)))).to_pylist()
        return max(widths), out

    assert found(2)[0] == 2 and found(2)[1] == found(100)[1]


def test_documents_are_not_shuffled_for_the_keys_of_the_few_found(spark, tmp_path, monkeypatch):
    texts = corpus(300, 5)
    index, documents, vocabulary, stats = stored(spark, texts, str(tmp_path / "p"), monkeypatch)
    queries = spark.createDataFrame([(1, "w3 w7")], "query_id int, query string")
    weights = bm25.term_weights(bm25.with_idf(vocabulary, stats), queries, True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = postings.top_k(index, documents, weights, stats, 7, ["doc_id"], limits=Limits(broadcast_rows=250))
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        got = [(h.doc_id, round(h.score, 6)) for h in sorted(hits.collect(), key=lambda h: h.rank)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(d, round(s, 6)) for d, s in okapi(texts, "w3 w7")[:7]]
