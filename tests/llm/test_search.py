"""Ranked lexical search against scoring every document; packing of numbers; the quality classifier."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkseek.llm import compression_quality, lexical_search, workload
from sparkseek.llm.lexical_search import LexicalIndex, terms_of

from .helpers import EDGES, clashing, documents, shared_passages

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_best(docs, queries, k):
    counts = [(doc_id, Counter(brute_terms(text))) for doc_id, text in docs]
    n_documents, n_terms = sum(1 for _, c in counts if c), sum(c.total() for _, c in counts)
    df = Counter(term for _, c in counts for term in c)
    out = []
    for number, text in queries:
        scored = []
        for doc_id, c in counts:
            m = 75 + (25 * c.total() * n_documents) // n_terms if n_terms else 0
            score = sum(
                times * floor(1000 * log((2 * n_documents + 2) / (2 * df[term] + 1))) * ((10**9 * c[term]) // (1000 * c[term] + 12 * m))
                for term, times in Counter(brute_terms(text)).items() if term in c
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(number, rank + 1, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_packing():
    pick = random.Random(1)
    for _ in range(50):
        values = np.array([pick.randrange(1 << pick.choice([3, 7, 8, 14, 15, 21, 28, 32])) for _ in range(pick.randint(0, 300))], dtype=np.int64)
        data, start = lexical_search.packed(values)
        assert lexical_search.unpacked(data.tobytes()).tolist() == values.tolist()
        assert start[-1] == len(data) and len(start) == len(values) + 1


@pytest.mark.parametrize("shard_bytes,block,reach,k,round_terms", [(1 << 24, 128, 8192, 20, 50_000), (400, 4, 16, 3, 20), (20_000, 8, 64, 5, 1)])
def test_search_equals_scoring_all(spark, tmp_path, monkeypatch, shard_bytes, block, reach, k, round_terms):
    monkeypatch.setattr(lexical_search, "BLOCK", block)
    monkeypatch.setattr(lexical_search, "RANGE", reach)
    pick = random.Random(4)
    common = [f"t{n}" for n in range(40)]
    rows = [(n, text) for n, text in enumerate(shared_passages(150, 5))]
    rows += [(1000 + n, " ".join(pick.choices(common, weights=[1 / (1 + r) for r in range(40)], k=pick.choice([3, 40, 300])))) for n in range(250)]
    rows += [(1001, "T3 t3,t4;É"), (1001, "T3 t3,t4;É"), (None, "t39 t38"), (None, "t39 t38"), *EDGES]
    queries = [(n, " ".join(pick.choices(common, k=pick.randint(1, 12)))) for n in range(12)]
    queries += [(50, "T3 t3 É nowhere"), (51, None), (52, ""), (53, "nowhere"), (54, rows[3][1]), (55, "w w"), (55, "xx")]
    index = LexicalIndex(spark, str(tmp_path / "index"))
    docs = clashing(documents(spark, rows))
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    index.add(docs.filter(half), shard_bytes)
    index.add(docs.filter(~half | half.isNull()), shard_bytes)
    found = index.search(clashing(spark.createDataFrame(queries, "item_id long, text string")), k, round_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(row) for row in found.collect()), key=repr) == brute_best(rows, queries, k)


def test_search_of_nothing(spark, tmp_path):
    queries = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for name, rows in (("none", []), ("empty", [(1, None), (2, "!!")])):
        index = LexicalIndex(spark, str(tmp_path / name))
        index.add(documents(spark, rows))
        assert index.search(queries).count() == 0
        assert index.search(queries.limit(0)).count() == 0


def test_blocks_are_left_compressed():
    """Lists that can't lift a document over the bar are read in blocks with candidates only."""
    n = 4000
    shard = lexical_search._Shard()
    for doc in range(n):
        shard.add(doc, "the " * (1 + doc % 3) + ("rare " * 9 if doc % 400 == 7 else ""))
    rows = shard.rows(0).to_pylist()
    lengths = np.frombuffer(rows[0]["packed"], dtype=np.int64).reshape(3, -1)[2]
    lists = {}
    for term in ("the", "rare"):
        own = [row for row in rows if row["term"] == term]
        columns = {name: np.array([row[name] for row in own]) for name in ("n", "first", "last", "most", "least")}
        lists[term] = lexical_search._List(columns, [row["packed"] for row in own], (lengths, n, int(lengths.sum())))
    best = lexical_search.best_of_shard([(lists["the"], 1), (lists["rare"], 9000)], np.arange(n), 5)
    assert [doc for _, doc in best] and all(doc % 400 == 7 for _, doc in best)
    assert lists["the"].read.sum() <= 10 < len(lists["the"].read)
    assert terms_of("AÉ-b_9") == ["aÉ".encode(), b"b", b"9"]


def test_quality_is_learned(spark):
    found = workload.queries()["op11_quality"](spark, "/root/testdata/sf0.1")
    held = found.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([row for row in held if row.quality == kind] for kind in (1, 0))
    assert sum(row.predicted for row in good) / len(good) > 0.97
    assert sum(1 - row.predicted for row in bad) / len(bad) > 0.93
    assert all(0 <= row.score <= 1 for row in held)


def test_quality_of_odd_inputs(spark):
    docs = clashing(documents(spark, EDGES + [(10 + k, f"plain words here {k} and some more") for k in range(40)] + [(60 + k, f"BAD!! $$$ {k} !!! ***") for k in range(40)]))
    labels = spark.createDataFrame([(10 + k, 1) for k in range(40)] + [(60 + k, 0) for k in range(40)] + [(None, 1), (3, None), (999, 0), (12, 1)], "doc_id long, quality int")
    model = compression_quality.train(docs, labels)
    found = compression_quality.score(docs, model, added="own")
    assert found.columns == [*docs.columns, "own"]
    rows = found.collect()
    assert all(0 <= row.own <= 1 for row in rows)
    prior = 41 / 82
    assert all(abs(row.own - prior) < 1e-9 for row in rows if not row.text)
    mean = lambda low: np.mean([row.own for row in rows if row.doc_id is not None and low <= row.doc_id < low + 40])
    assert mean(10) > mean(60) + 0.3
    for some, score in ((labels.limit(0), 0.5), (labels.filter("quality = 1"), 1.0), (labels.filter("quality = 0"), 0.0)):
        assert {row.own for row in compression_quality.score(docs, compression_quality.train(docs, some), added="own").collect()} == {score}
    assert compression_quality.score(docs.limit(0), model, added="own").count() == 0
