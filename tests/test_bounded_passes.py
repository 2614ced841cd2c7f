"""Passes over texts: one Python worker for each task, no more memory than a piece and the best rows, no shuffle for lists."""

import io
import tracemalloc
from contextlib import redirect_stdout

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseek import batches
from sparkseek.operators import bm25, diffs, exact, postings, topk
from sparkseek.plans import indexing
from sparkseek.workload import data as D
from sparkseek.workload import registry, retrieval


def plan(df):
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_chunk_rows_need_one_python_worker(spark):
    files = spark.createDataFrame([("a/b.java", "class A { speed }")], "path string, text string")
    shown = plan(indexing.chunk_rows(files))
    assert sum(shown.count(node) for node in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas")) == 1


def test_posting_lists_are_not_shuffled(spark):
    docs = spark.createDataFrame([("base", k, "speed car door") for k in range(50)], "store string, doc int, text string")
    documents = postings.written(postings.placed(bm25.counted(docs, ["doc"], "text"), ["store", "doc"]), "documents")
    rows = postings.postings(documents)
    assert "Exchange" not in plan(rows)
    assert {(r.term, r.n) for r in postings.vocabulary(rows).withColumnRenamed("df", "n").collect()} == {("speed", 50), ("car", 50), ("door", 50)}


def test_long_slices_give_several_rows_and_lose_none(spark, monkeypatch):
    docs = spark.createDataFrame([("base", k, f"speed w{k % 3} w{k % 3}") for k in range(40)], "store string, doc int, text string").coalesce(1)
    documents = postings.written(postings.placed(bm25.counted(docs, ["doc"], "text"), ["store", "doc"]), "documents")
    batches = documents.select("store", "_slice", "_doc", "dl", "terms").toArrow().to_batches(max_chunksize=7)
    monkeypatch.setattr(postings, "SEGMENT_TERMS", 10)
    rows = [row for batch in postings._sliced(iter(batches)) for row in batch.to_pylist()]
    speed = [row for row in rows if row["term"] == "speed"]
    assert len(speed) > 1 and sorted(d for row in speed for d in row["docs"]) == list(range(40))
    assert all(row["n"] == len(row["docs"]) and row["most"] == max(row["tfs"]) and row["least"] == min(row["dls"]) == 3 for row in rows)
    assert sum(row["n"] for row in rows if row["term"] == "w1") == 13


def test_first_rows_of_a_pattern_hold_no_more_than_asked(monkeypatch):
    first = exact._First(3)
    for start in range(5000, 0, -100):
        piece = pa.RecordBatch.from_pydict({"root_no": [1 - k % 2 for k in range(100)], "path": [f"p{start + k:05}" for k in range(100)]})
        first.add(piece, ["speed", "car"], [k for k in range(100) for _ in (0, 1)], [0, 1] * 100)
        assert all(len(rows) <= 3 for rows in first.held.values())
    assert first.held["speed"] == first.held["car"] == [(0, "p00101"), (0, "p00103"), (0, "p00105")]


def test_running_best_cuts_early():
    best = topk.RunningBest(2, ["query_id"], ["key"])
    for part in range(40):
        best.add(topk.pd.DataFrame({"query_id": 1, "key": np.arange(10_000) + 10_000 * part, "score": 1.0}))
        assert best.rows <= 60_000
    assert best.result()["key"].tolist() == [0, 1]


@pytest.mark.parametrize("text", [None, "", "9abc 1.2.b ..x_9 a", "ſpeed K9 İx", "a.b..c 0_0", "É été_x", "Kab"])
def test_counted_tokens_are_those_of_the_pattern(spark, text):
    import re

    from sparkseek import fixed_values as fv

    tokens = re.findall(fv.TOKEN_PATTERN, (text or "").lower())
    dl, terms = bm25.Counts.of(["speed", text, "car"]).columns()
    assert dl[1].as_py() == (None if text is None else len(tokens))
    assert [(t["term"], t["tf"]) for t in terms[1].as_py() or []] == [(t, tokens.count(t)) for t in sorted(set(tokens))]


@pytest.mark.parametrize("text", ["", "a", "Ab", "x" * 256, "x" * 300 + " y", "1 " * 200 + "Word-2", "é" * 250 + " abcdefgh ij", "a b c d_ e", "é" * 255 + "ab cd"])
def test_word_of_a_path_is_the_first_of_the_whole_text(spark, text):
    import re

    row = D.with_path(spark.createDataFrame([(7, text, "en", "source-1")], "doc_id long, text string, lang string, source string")).first()
    found = re.search("[a-z_][a-z0-9_]+", text.lower())
    assert row.path.rsplit("/", 1)[1] == f"{found[0] if found else 'unit'}-7.java"


def test_texts_of_a_batch_are_not_in_python_all_at_once():
    texts = pa.array([f"{k}\n" + "x" * 1_000_000 for k in range(60)])
    patches = pa.array([f"@@ -1 +1 @@\n-{k}\n+new {k}\n" if k % 2 else None for k in range(60)])
    tracemalloc.start()
    patched = diffs.apply_diff_udf.func(texts, patches)
    windows = diffs.symbol_window_udf(2_000_000).func(texts, pa.array([["x"]] * 60))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert patched.null_count == 30 and all(patched[k].as_py().startswith(f"new {k}\nxx") for k in range(1, 60, 2))
    assert windows.field("text").equals(texts) and windows.field("cut").true_count == 0
    assert most < 20_000_000


def test_tenants_over_one_tree_share_its_base_layer(spark, monkeypatch):
    built = []
    build = indexing.build_store
    monkeypatch.setattr(indexing, "build_store", lambda files, folder, *rest: (built.append(folder), build(files, folder, *rest))[1])
    folder = "/root/testdata/./sf0.001"
    first, second = retrieval._overlapping(spark, folder), retrieval.search_over_tree(spark, folder)
    assert len(built) == len(set(built)) == 3 and sum("/_base/" in at for at in built) == 1
    copies = [s.store.table("chunks").where("store = 'customer' AND content LIKE '%local change'").count() for s in (first, second)]
    assert copies[0] and not copies[1]


def test_turns_of_other_conversations_are_not_grouped(spark):
    bugs = retrieval.reported(spark, "/root/testdata/sf0.001")
    shown = plan(bugs)
    assert "LeftSemi" in shown and shown.rindex("LeftSemi") > shown.rindex("collect_list")  # children stand below
    assert bugs.count() == D.bug_queries(spark, "/root/testdata/sf0.001").count()


def test_a_query_hands_python_small_batches_unless_the_session_names_a_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.range(4000).select(F.repeat(F.lit("x"), 5000).alias("text")).coalesce(1)

    def sizes(parts):
        for batch in parts:
            yield pa.RecordBatch.from_pydict({"bytes": [batch.nbytes]})

    registry.queries()["unit_chunks"](spark, "/root/testdata/sf0.001")
    found = [row.bytes for row in texts.mapInArrow(sizes, "bytes long").collect()]
    assert sum(found) > 20_000_000 and max(found) < 1.1 * batches.BATCH_BYTES
    own = spark.newSession()
    own.conf.set(name, "9m")
    batches.bound_batches(own)
    assert own.conf.get(name) == "9m"
