import math
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek import fixed_values as fv
from sparkseek.config import Limits, Ranking, Settings
from sparkseek.functions import text as X
from sparkseek.operators import bm25, consensus, dense, exact, fusion, priors, rerank, vector_index
from sparkseek.plans.search import HybridSearch

TOKENS = re.compile(fv.TOKEN_PATTERN)
CORPUS = {
    "a": "the car the speed car", "b": "the door opens", "c": "the speed signal speed", "d": "the the the", "e": "1 2 3",
    "f": "unrelated words only here",
}
QUERIES = {1: "the speed speed car", 2: "door", 3: "nothing matches zzz", 4: "the"}


def okapi(corpus, query, k1=1.5, b=0.75, epsilon=0.25):
    docs = {d: TOKENS.findall(t.lower()) for d, t in corpus.items()}
    n, avgdl = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for tokens in docs.values() for t in set(tokens))
    idf = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = epsilon * sum(idf.values()) / len(idf)
    idf = {t: floor if v < 0 else v for t, v in idf.items()}
    scores = {}
    for d, tokens in docs.items():
        tf = Counter(tokens)
        scores[d] = sum(idf.get(t, 0) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(tokens) / avgdl)) for t in TOKENS.findall(query.lower()))
    ranked = sorted(((round(s, 9), d) for d, s in scores.items() if s > 0), key=lambda x: (-x[0], x[1]))
    return [(d, s) for s, d in ranked]


@pytest.mark.parametrize("limits", [Limits(), Limits(weights_per_block=1)])
def test_bm25_equals_brute_force_in_blocks(spark, limits):
    docs = spark.createDataFrame([("base", d, t) for d, t in CORPUS.items()], "store string, doc string, text string")
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id int, query string")
    hits = bm25.search(docs, queries, 3, ["doc"], "text", limits=limits).collect()
    for q, text in QUERIES.items():
        got = [(r.doc, r.score) for r in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)]
        assert [(d, pytest.approx(s, abs=1e-8)) for d, s in okapi(CORPUS, text)[:3]] == got


def test_bm25_with_one_word_in_a_third_of_all_tokens(spark):
    corpus = {f"d{i:03}": "hot " * (i % 7 + 1) + f"w{i} tail" for i in range(200)}
    docs = spark.createDataFrame([("base", d, t) for d, t in corpus.items()], "store string, doc string, text string")
    queries = spark.createDataFrame([(1, "hot w17"), (2, "hot")], "query_id int, query string")
    hits = bm25.search(docs, queries, 10, ["doc"], "text").collect()
    for q, text in ((1, "hot w17"), (2, "hot")):
        assert [h.doc for h in sorted((h for h in hits if h.query_id == q), key=lambda h: h.rank)] == [d for d, _ in okapi(corpus, text)[:10]]


@pytest.mark.parametrize("limits", [Limits(), Limits(queries_per_slice=3)])
def test_dense_equals_brute_force_with_ties(spark, limits):
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(60, 4)).round(2)
    vectors[10:30] = vectors[5]  # a third of all rows are copies
    queries = np.vstack([vectors[5], rng.normal(size=(7, 4)), np.zeros((1, 4))])
    v = spark.createDataFrame([("base" if i % 2 else "customer", i, [float(x) for x in row]) for i, row in enumerate(vectors)], "store string, id int, embedding array<double>")
    q = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(queries)], "query_id int, embedding array<double>")
    hits = dense.top_k(v.repartition(5), q, 4, ["id"], limits).collect()
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]
    sims = np.clip(np.round(unit(queries) @ unit(vectors).T, 9), 0, 1)
    for qi in range(len(queries)):
        for store, members in (("base", range(1, 60, 2)), ("customer", range(0, 60, 2))):
            best = sorted(members, key=lambda i: (-sims[qi, i], i))[:4]
            got = [h.id for h in sorted((h for h in hits if h.query_id == qi and h.store == store), key=lambda h: h.rank)]
            assert got == best


@pytest.mark.parametrize("limits", [Limits(), replace(Limits(), queries_per_slice=0, broadcast_bytes=8)])
def test_exact_matches(spark, limits):
    if limits.queries_per_slice == 0:
        limits = replace(limits, queries_per_slice=1)
    files = [("vendor/b.java", "Speed here"), ("device/a.java", "car SPEED"), ("vendor/out/c.java", "speed"), ("vendor/a.py", "speed"),
             ("other/a.java", "speed"), ("vendor/a.java", "none"), ("vendor/c.kt", "carspeed")]
    queries = [(1, "Speed"), (2, "car speed"), (3, "is on")]
    f = spark.createDataFrame(files, "path string, text string")
    q = spark.createDataFrame(queries, "query_id int, query string")
    hits = exact.top_k(f, q, 2, ["vendor", "device"], limits=limits).orderBy("query_id", "rank").collect()
    assert [(h.query_id, h.path, h.rank) for h in hits] == [
        (1, "vendor/b.java", 1), (1, "vendor/c.kt", 2), (2, "vendor/b.java", 1), (2, "vendor/c.kt", 2)]


def test_matcher_keeps_few_automata():
    assert exact._matcher("one", ["ab", "b"])("xaby") == {0, 1}
    for key in range(9):
        assert exact._matcher(key, ["a", str(key)])(f"-{key}") == {1}
    assert len(exact._MACHINES) <= 4


HIT = "query_id int, channel string, store string, path string, idx int, rank int, content_len int, layer string"


def test_fusion_rules(spark):
    rows = [
        (1, "dense", "base", "p", 0, 1, 10, "L0"), (1, "dense", "base", "p", 3, 4, 30, "L3"), (1, "bm25", "customer", "p", 2, 2, 30, "L2"),
        (1, "exact", None, "p", -1, 1, 20, "Lx"), (1, "exact", None, "q", -1, 2, 5, "Lq"), (1, "bm25", "base", "", 0, 1, 9, "no"),
    ]
    fused = {r.path: r for r in fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, HIT)).collect()}
    assert set(fused) == {"p", "q"}
    p = fused["p"]
    assert p.score == pytest.approx(1 / 61 + 1 / 64 + 1 / 62 + 1 / 61, abs=1e-11)
    assert p.source == "bm25+dense+exact" and p.store == "customer"
    assert (p.content_channel, p.content_idx, p.layer) == ("dense", 3, "L3")
    assert p.rrf_parts == {"dense": pytest.approx(1 / 64), "bm25": pytest.approx(1 / 62), "exact": pytest.approx(1 / 61)}
    assert fused["q"].store is None
    once = fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, HIT), Ranking(rrf_vote="path")).where("path = 'p'").first()
    assert once.score == pytest.approx(2 / 61 + 1 / 62, abs=1e-11)


def test_normalisation_and_priors(spark):
    fused = spark.createDataFrame(
        [(1, "vendor/x/Speed.aidl", 0.5, "customer", "customer"), (1, "a/2.0/b.java", 0.4, None, "hidl_legacy"), (1, "z/z.txt", 0.1, "base", "other"),
         (2, "only/one.c", 0.3, "base", "native"), (3, "a/2.0/b.java", 0.4, None, "hidl_legacy")],
        "query_id int, path string, score double, store string, layer string")
    queries = spark.createDataFrame([(1, "aidl Speed"), (2, "shall"), (3, "hidl")], "query_id int, query string")
    rows = {(r.query_id, r.path): r for r in priors.apply_priors(fusion.normalize_base(fused), queries).collect()}
    assert (1, "a/2.0/b.java") not in rows and (3, "a/2.0/b.java") in rows
    assert rows[1, "vendor/x/Speed.aidl"].prior == pytest.approx(0.12 + 0.06 + 0.08 + 0.02)  # stem keeps its case: no symbol prior
    assert rows[2, "only/one.c"].base_norm == 0.5
    folded = replace(Settings(), ranking=Ranking(symbol_prior_casefold=True))
    again = {r.path: r for r in priors.apply_priors(fusion.normalize_base(fused), queries, folded).where("query_id = 1").collect()}
    assert again["vendor/x/Speed.aidl"].prior == pytest.approx(0.38)


def test_rank_scopes(spark):
    rows = [(1, "base", "a", 0.1), (1, "base", "b", 0.9), (1, "customer", "c", 0.5)]
    hits = spark.createDataFrame(rows, "query_id int, store string, path string, score double")
    order = lambda scope: [r.path for r in fusion.rank_across_stores(hits, ["path"], scope).orderBy("rank", "store").collect()]
    assert order("concat") == ["b", "a", "c"] and order("global") == ["b", "c", "a"] and order("per_store") == ["b", "c", "a"]


def test_rerankers(spark):
    pool = spark.createDataFrame([(1, "q", "a", "x", 0.2, 1), (1, "q", "b", "y", 0.9, 2)], "query_id int, query string, path string, content string, score double, rank int")
    scored = rerank.by_pairs(pool, lambda q, d: F.when(F.startswith(d, F.lit("a")), 1000.0).otherwise(-1000.0), 1).first()
    assert (scored.path, scored.score) == ("a", pytest.approx(0.75 + 0.05))
    assert rerank.cut(pool, 1).first().path == "b"

    def loader(name):
        if name != "second":
            raise OSError(name)
        return "scorer"

    assert rerank.choose_scorer([None, "first", "second"], loader) == ("second", "scorer")
    assert rerank.choose_scorer(["first"], None) is None


def test_filter_with_fallback(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "vss"), (2, 1, "a"), (2, 2, "b")], "query_id int, rank int, layer string")
    kept = fusion.prefer_matching(hits, F.col("layer") == "vss", 8).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.layer) for r in kept] == [(1, 1, "vss"), (2, 1, "a"), (2, 2, "b")]


def test_plan_prunes_before_the_shuffle(spark):
    v = spark.createDataFrame([("base", 1, [1.0])], "store string, id int, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0])], "query_id int, embedding array<double>")
    plan = dense.top_k(v, q, 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "WindowGroupLimit" in plan


def test_vector_index_recall(spark, tmp_path):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.lit("base").alias("store"), "vec_id", "embedding")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    centroids = vector_index.fit(vectors, ["vec_id"], lists=16, sample=1000)
    vector_index.build(vectors, centroids, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() == vectors.count()  # every row, not the sample
    exact = {(r.query_id, r.vec_id) for r in dense.top_k(vectors, queries, 10, ["vec_id"]).collect()}
    found = {(r.query_id, r.vec_id) for r in vector_index.top_k(index, centroids, queries, 10, ["vec_id"], probes=12).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    everything = vector_index.top_k(index, centroids, queries, 10, ["vec_id"], probes=16, limits=Limits(queries_per_slice=7))
    assert {(r.query_id, r.vec_id) for r in everything.collect()} == exact


def test_nothing_is_cut(spark, tmp_path):
    """A passage behind any number of characters counts, and so does a query's last keyword."""
    filler = "\n".join(f"line {k} of padding" for k in range(400))
    root = Settings().scope_roots()[0]
    files = spark.createDataFrame(
        [(f"{root}/a/Long.java", filler + "\nTELLING_NINTH_NAME zebra quagga okapi"), (f"{root}/a/Short.java", "padding only")], "path string, text string",
    )
    words = " ".join(f"COMMON_{k}_NAME" for k in range(12)) + " TELLING_NINTH_NAME"
    queries = spark.createDataFrame([(1, words)], "query_id int, query string")
    assert exact.query_keywords(queries).where("keyword = 'telling_ninth_name'").count() == 1
    settings = Settings()
    search = HybridSearch(None, files, settings)
    found = search.search(queries).collect()
    assert [row.path for row in found] == [f"{root}/a/Long.java"] and found[0].content.endswith("okapi") and len(found[0].content) > 2000
    pool = spark.createDataFrame([(1, "zebra quagga okapi", "a", filler), (1, "zebra quagga okapi", "b", filler + " zebra quagga okapi" * 40)],
                                 "query_id int, query string, path string, content string")
    pool = pool.withColumns({"score": F.lit(0.5), "rank": F.lit(1), "query_vector": search.embed(F.col("query"))})
    ranked = rerank.by_embedding(pool, search.embed, 2, settings).orderBy("rank").collect()
    assert ranked[0].path == "b" and ranked[0].rerank_raw > ranked[1].rerank_raw


def test_layers_and_hits_have_no_limit_of_their_own(spark):
    report = "suspend resume binder vhal car property vss signal hmi launcher selinux native crash kernel driver"
    row = spark.createDataFrame([(report,)], "bug string")
    every = row.select(consensus.route_layers(F.col("bug"), F.lit("vhal"), F.lit(None), F.lit(None))).first()[0]
    three = row.select(consensus.route_layers(F.col("bug"), F.lit("vhal"), F.lit(None), F.lit(None), max_layers=3)).first()[0]
    assert len(every) > 5 and three == every[:3]
    log = "x" * 10_000 + "END"
    assert row.select(X.framed_task(F.col("bug"), F.lit(log))).first()[0].count("END") == 1
