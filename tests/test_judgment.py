import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek import workload
from sparkseek.operators import consensus as C
from sparkseek.operators import diffs as V
from sparkseek.operators import evaluation as E
from sparkseek.operators import grounding as G
from sparkseek.operators.line_difference import changed_ranges, changed_ranges_udf, inserted
from sparkseek.plans import diagnosis as L

NOTE = "bug_id int, layer string, verdict string, owns_layer boolean, confidence double, note_no int"


@pytest.mark.parametrize("votes, status, review, rejects", [
    ([("vhal", "AGREE", True, 0.9)], "agree", False, False),
    ([("vhal", "DISAGREE", True, 0.9), ("hmi", "AGREE", False, 1.0)], "reject", True, True),
    ([("vhal", "AGREE", True, 0.9), ("hmi", "DISAGREE", True, 0.2)], "agree_with_dissent", True, False),
    ([("vhal", "AGREE", True, 0.5), ("hmi", "DISAGREE", True, 0.5)], "conflict", True, False),
    ([("vhal", "ABSTAIN", True, 0.9), ("hmi", "AGREE", False, 0.9)], "weak", True, False),
    ([("vhal", "AGREE", True, 0.0)], "weak", True, False),
    ([("vhal", "AGREE", True, 0.0), ("hmi", "DISAGREE", True, 0.1)], "reject", True, True),
])
def test_consensus(spark, votes, status, review, rejects):
    rows = [(1, *v, i) for i, v in enumerate(votes)]
    got = C.build_consensus(spark.createDataFrame(rows, NOTE)).first()
    assert (got.status, got.force_human_review, got.reject_committed) == (status, review, rejects)
    assert got.by_layer == {v[0]: v[1] for v in votes} and f"(n={len(votes)})" in got.summary


def test_committed_layer_objection_forces_review(spark):
    rows = [(1, "vhal", "AGREE", True, 0.9, 0), (1, "hmi", "DISAGREE", False, 0.9, 1)]
    committed = spark.createDataFrame([(1, "hmi")], "bug_id int, committed_layer string")
    assert C.build_consensus(spark.createDataFrame(rows, NOTE), committed).first().force_human_review


def test_verdicts(spark):
    answers = ['{"verdict": "agree", "owns_layer": true, "confidence": 7, "target": " t ", "reason": "r"}', '```json\n{"verdict": "DISAGREE"}\n```',
               "I think PARTIAL, then AGREE", "AGREE outside my layer", "{bad} DISAGREE", "", '{"verdict": "AGREE", "owns_layer": true, "confidence": null}']
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, raw string")
    got = [(r.verdict, r.owns_layer, r.confidence, r.target) for r in C.parse_verdicts(df).orderBy("i").collect()]
    assert got == [("AGREE", True, 1.0, "t"), ("ABSTAIN", False, 0.5, ""), ("ABSTAIN", True, 0.5, ""), ("ABSTAIN", False, 0.5, ""),
                   ("DISAGREE", True, 0.5, ""), ("ABSTAIN", True, 0.5, ""), ("AGREE", True, 0.5, "")]


def test_routing(spark):
    row = spark.createDataFrame([("Binder died after resume, CarProperty in VSS", "vhal", ["hmi", "nonsense", "vhal"], "frameworks/base/A.java")],
                                "bug string, layer string, cand array<string>, blob string")
    routed = row.select(C.route_layers(F.col("bug"), F.col("layer"), F.col("cand"), F.col("blob"), max_layers=5)).first()[0]
    assert routed == ["startup_power", "binder", "vhal", "hmi", "frameworks"]
    packs = row.select(C.context_packs(F.lit("vss"), F.lit("nothing"), F.lit(""))).first()[0]
    assert packs == ["sdv_vss"]


ORIGINAL = "one\ntwo\n\n  three\nfour"


@pytest.mark.parametrize("diff, expected", [
    ("@@ -1,2 +1,2 @@\n one\n-two\n+TWO", "one\nTWO\n\n  three\nfour"),
    ("@@ -2,3 +2,3 @@\n two\n\n-three\n+3", "one\ntwo\n\n3\nfour"),
    ("@@ -1 +1 @@\n-wrong\n+x", None),
    ("@@ -1 +1 @@\n wrong\n+x", None),
    ("@@ bad @@\n one", None),
    ("no hunk", None),
    ("--- a/f\n+++ b/f\n@@ -1 +1 @@\n-one\n+1\n@@ -5 +5 @@\n-four\n+4", "1\ntwo\n\n  three\n4"),
    ("@@ -5,1 +5,2 @@\n four\n+five", "one\ntwo\n\n  three\nfour\nfive"),
])
def test_apply(diff, expected):
    assert V.apply_diff(ORIGINAL, diff) == expected


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "x"]), min_size=1, max_size=8), st.lists(st.sampled_from(["a", "b", "new", "y"]), max_size=8))
def test_apply_inverts_a_generated_diff(old, new):
    import difflib

    diff = "\n".join(difflib.unified_diff(old, new, "a/f", "b/f", lineterm="", n=len(old)))
    if diff:
        assert V.apply_diff("\n".join(old), diff) == "\n".join(new)


LINES = st.lists(st.sampled_from(["a", "b", "c", "d"]), max_size=14)


@settings(max_examples=400, deadline=None)
@given(LINES, LINES)
def test_a_shortest_edit_script_inserts_as_few_lines_as_can_be(old, new):
    longest = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
    for i, one in enumerate(old):
        for j, two in enumerate(new):
            longest[i + 1][j + 1] = longest[i][j] + 1 if one == two else max(longest[i][j + 1], longest[i + 1][j])
    places = inserted(old, new)
    assert places == sorted(set(places)) and len(places) == len(new) - longest[-1][-1]
    rest, kept = iter(old), [line for k, line in enumerate(new) if k not in places]
    assert all(line in rest for line in kept)


def test_changed_ranges(spark):
    assert changed_ranges("a\nb\nc", "a\nx\ny\nc\nz") == [(2, 3), (5, 5)] and changed_ranges("a\nb", "b") == [] and changed_ranges("", "a") == [(1, 1)]
    many = [str(k % 97) for k in range(30_000)]
    edited = [line for k, line in enumerate(many) if k % 1000] + ["end"]
    assert changed_ranges("\n".join(many), "\n".join(edited)) == [(len(edited), len(edited))]
    rows = spark.createDataFrame([(1, "a", "b"), (2, None, "b"), (3, "a", None), (4, "a", "a"), (5, "", "")], "i int, o string, n string")
    got = {r.i: r.c for r in rows.select("i", changed_ranges_udf("o", "n").alias("c")).collect()}
    assert got == {1: [(1, 1)], 2: None, 3: None, 4: [], 5: []}


def test_check_diffs(spark):
    files = spark.createDataFrame([("f.c", "one\ntwo\n\nthree"), ("g.c", "x")], "path string, text string")
    answers = spark.createDataFrame([(1, "--- a/f.c\n+++ b/f.c\n@@ -1 +1 @@\n one\n-two\n+2\ntext\n+++ b/g.c\n@@ -1 +1 @@\n-nope\n+y"),
                                     (2, "--- a/gone.c\n+++ b/gone.c\n@@ -1 +1 @@\n-a"), (3, "+++ b/f.c\n@@ -1 +1 @@\n two\n\n three")], "id int, text string")
    got = {(r.id, r.hunk_no): r.problem for r in V.check_diffs(answers, files).collect()}
    assert got[1, 0] is None and "does not match" in got[1, 1] and "not found" in got[2, 0]
    assert got[3, 0] is None  # the empty line ends the hunk, so only its first line is checked
    spaced = spark.createDataFrame([(4, "+++ b/f.c\n@@ -1 +1 @@\n two\n \n three")], "id int, text string")
    assert "does not match" in V.check_diffs(spaced, files).first().problem
    assert V.check_diffs(spaced, files, ignore_blank_lines=True).first().problem is None


def test_window_and_drafts():
    text = "\n".join(f"line {i}" for i in range(100))
    window, cut = V.symbol_window(text, ["line 50"], 60)
    assert cut and "line 50" in window and len(window) <= 60 and window in text
    assert V.symbol_window(text, ["absent"], 60) == (text[:60], True) and V.symbol_window("ab", [], 5) == ("ab", False)
    draft = "say\n```diff\n--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y\n```\nafter\n---\nrule"
    assert V.drop_drafts(draft) == ("say\n" + V.DRAFT_NOTE + "\nafter\n---\nrule", True)
    kept = "intro" + "\n\n## Patch\n" + draft
    assert V.drop_drafts(kept, "\n\n## Patch\n") == (kept, False)


def test_windows_of_documents_without_a_word(spark, tmp_path):
    long = " \n\t" * 500
    texts = ["", " \n\t ", long, "two words"]
    rows = [(k, text, "en", "source-1") for k, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.cut, r.digest) for r in workload.queries()["symbol_windows"](spark, str(tmp_path)).collect()}
    heads = ["", " \n\t ", long[:1000], "two words"]
    assert got == {k: (head != text, hashlib.md5(head.encode()).hexdigest()) for k, (head, text) in enumerate(zip(heads, texts))}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=12), st.integers(0, 11), st.integers(1, 40))
def test_window_grows_evenly(lengths, at, budget):
    lines = ["x" * n for n in lengths]
    at %= len(lines)
    lines[at] = "name"
    text = "\n".join(lines)
    lines = text.splitlines()  # no line behind the last end
    cost = lambda top, bottom: sum(len(line) + 1 for line in lines[top:bottom + 1])
    # Of all windows around the line, the one that steps reach which add a line above and one below by turns.
    top, bottom, open_sides = at, at, ["above", "below"]
    while open_sides:
        side = open_sides.pop(0)
        wider = (top - 1, bottom) if side == "above" else (top, bottom + 1)
        if wider[0] >= 0 and wider[1] < len(lines) and cost(*wider) <= budget:
            top, bottom = wider
            open_sides.append(side)
    expected = (text, False) if len(text) <= budget else ("\n".join(lines[top:bottom + 1]), True)
    assert V.symbol_window(text, ["name"], budget) == expected


def test_unit_test_consistency(spark):
    row = spark.createDataFrame([("int known_value KNOWN_ID", "+++ b/f\n+fixSpeed()", "EXPECT_EQ(OTHER_ID, KNOWN_ID)")], "s string, p string, t string")
    got = row.select(V.test_consistency("s", "p", "t").alias("c")).first().c
    assert got.patched == ["fixSpeed"] and got.unrelated and got.unknown == ["OTHER_ID"]


def test_commit(spark):
    messages = spark.createDataFrame([(1, "saw src/car/A.java and setSpeed"), (1, "also lib/b/A.java lib/x/Only.cpp"), (2, "nothing"), (3, "vendor/p.java go")], "run_id int, text string")
    paths = G.evidence_paths(messages)
    claims = spark.createDataFrame([(1, "b/src/car/A.java"), (1, "A.java"), (1, "q/Only.cpp"), (1, ""), (2, "src/car/A.java")], "run_id int, claim string")
    snapped = {(r.run_id, r.claim): r.snapped for r in G.snap_paths(claims, paths).collect()}
    assert snapped == {(1, "b/src/car/A.java"): "src/car/A.java", (1, "A.java"): None, (1, "q/Only.cpp"): "lib/x/Only.cpp", (1, ""): None, (2, "src/car/A.java"): None}
    raw = lambda **k: "```json\n" + json.dumps(k) + "\n```"
    answers = spark.createDataFrame([
        (1, raw(file="a/src/car/A.java", symbols=["setSpeed", "ghost", ""], property_ids=["saw"], root_cause=" c ", candidates=[{"path": "Only.cpp", "why": "w" * 300}])),
        (2, "no json"), (3, raw(file="vendor/p.java", symbols=["go"]))], "run_id int, raw string")
    dx = {r.run_id: r for r in G.commit(answers, messages, paths).collect()}
    assert dx[1].file == "src/car/A.java" and dx[1].symbols == ["setSpeed"] and dx[1].property_ids == ["saw"] and dx[1].confidence == "medium"
    assert [c.path for c in dx[1].candidates] == ["src/car/A.java", "lib/x/Only.cpp"] and len(dx[1].candidates[1].why) == 300
    assert dx[1].grounding_problems == ["symbol 'ghost' not found in evidence — dropped"] and dx[1].root_cause == "c"
    assert (dx[2].committed, dx[2].confidence, dx[2].grounding_problems) == (False, "low", ["no target file proposed"])
    assert (dx[3].confidence, dx[3].layer) == ("high", "customer")
    frame = G.commit(answers, messages, paths)
    assert {r.run_id: r.v for r in frame.select("run_id", G.needs_review().alias("v")).collect()} == {1: True, 2: True, 3: False}
    hits = spark.createDataFrame([(2, 1, "x/y.c", "native", 0.5)], "run_id int, rank int, path string, layer string, score double")
    filled = {r.run_id: r for r in G.with_fallback_candidates(frame, hits).collect()}
    assert filled[2].fallback and filled[2].candidates[0].why == "retriever-ranked (score=0.500)" and not filled[1].fallback
    assert "_(not committed)_" in frame.where("run_id = 2").select(G.render()).first()[0]


def test_debate_stops_when_votes_stand_still(spark):
    seats = spark.createDataFrame([(1, "vhal"), (1, "hmi"), (2, "vhal")], "bug_id int, layer string")
    committed = spark.createDataFrame([(1, "vhal"), (2, "vhal")], "bug_id int, committed_layer string")
    voter = lambda wanted: wanted.select("bug_id", "layer", F.when(F.col("bug_id") == 2, '{"verdict": "AGREE", "owns_layer": true}').otherwise(
        '{"verdict": "DISAGREE", "owns_layer": true}').alias("raw"))
    assert L.debate(seats, committed, None) is None
    notes, consensus = L.debate(seats, committed, voter)
    got = {r.bug_id: (r.status, r.rounds) for r in consensus.collect()}
    assert got == {1: ("reject", 2), 2: ("agree", 1)} and notes.count() == 3
    hints = spark.createDataFrame([(1, ["CarService"]), (2, ["x"])], "bug_id int, hints array<string>")
    assert [r.bug_id for r in L.wants_relocation(consensus, hints).collect()] == [1]
    assert L.wants_relocation(consensus, hints, 1).count() == 0
    assert L.continue_tools(7, True) and not L.continue_tools(8, True) and not L.continue_tools(1, False)


def test_patch_loop(spark):
    targets = spark.createDataFrame([(1, "a.yaml", "x", []), (2, "b.cpp", "x", []), (3, "c.java", "x", []), (4, "d.aidl", "x", [])],
                                    "bug_id int, path string, text string, symbols array<string>")
    good, bad = "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-x\n+y", "--- a/f\n+++ b/f\n@@ -1 +1 @@\n-z\n+y"

    def patcher(wanted):
        answer = F.when((F.col("bug_id") == 1) & (F.col("attempt") == 1), bad).when(F.col("bug_id") == 3, "N/A").when(F.col("bug_id") == 4, bad).otherwise(good)
        return wanted.select("bug_id", answer.alias("answer"))

    assert L.patch_loop(targets, None) is None
    notes = {r.bug_id: r.note for r in L.patch_loop(targets, patcher).collect()}
    assert "NOT verified" in notes[1] and "NOT verified" in notes[2] and notes[3] == "" and "after retries" in notes[4]
    assert targets.select(V.check_style(F.lit(".cpp"))).first()[0] == "unavailable"
    verified = {r.bug_id: r.note for r in L.patch_loop(
        targets, patcher, parser=lambda text, suffix: F.struct(F.lit(True).alias("ok"), F.array().cast("array<string>").alias("errors"), F.lit(True).alias("verified"))).collect()}
    assert verified[1] == "" and "style NOT enforced" in verified[2]


def test_silent_backends_lose_no_bug(spark):
    seats = spark.createDataFrame([(1, "vhal"), (1, "hmi"), (2, "vhal")], "bug_id int, layer string")
    committed = spark.createDataFrame([(1, "vhal"), (2, "vhal")], "bug_id int, committed_layer string")
    voter = lambda wanted: wanted.where("bug_id = 1 AND layer = 'vhal'").select("bug_id", "layer", F.lit('{"verdict": "AGREE", "owns_layer": true}').alias("raw"))
    _, consensus = L.debate(seats, committed, voter)
    assert {r.bug_id: (r.status, r.abstain) for r in consensus.collect()} == {1: ("agree", 1), 2: ("weak", 1)}
    targets = spark.createDataFrame([(1, "a.py", "x", []), (2, "b.py", "x\n" * 20_000 + "y", ["x"])], "bug_id int, path string, text string, symbols array<string>")
    far = "--- a/f\n+++ b/f\n@@ -20001 +20001 @@\n-y\n+z"
    patched = L.patch_loop(targets, lambda wanted: wanted.where("bug_id = 2").select("bug_id", F.lit(far).alias("answer")))
    notes = {r.bug_id: r.note for r in patched.collect()}
    assert "no answer came" in notes[1] and "no parser" in notes[2]  # the whole file is patched, not the part that was shown


def test_catalog_keys_count_at_any_depth():
    from sparkseek.operators.chunking import looks_like_catalog
    filler = {f"k{i}": "x" * 50 for i in range(200)}
    assert looks_like_catalog({**filler, "z": {"y": [{"datatype": "int"}]}})
    assert not looks_like_catalog({**filler, "z": "datatype"}) and not looks_like_catalog([1])


def test_evaluation(spark):
    ranked = spark.createDataFrame([(1, 1, "x/a.java"), (1, 2, "./B/c.java"), (2, 6, "d.c"), (3, 1, "xa.java")], "query_id int, rank int, path string")
    gold = spark.createDataFrame([(1, "c.java"), (2, "d.c"), (3, "a.java")], "query_id int, path string")
    ranks = E.gold_ranks(ranked, gold, 5)
    assert {r.query_id: r.rank for r in ranks.collect()} == {1: 2, 3: 1}
    assert {r.query_id for r in E.gold_ranks(ranked, gold, 5, strict=True).collect()} == {1}
    answers = spark.createDataFrame([(1, "@@", True), (2, f"@@ {E.WARNING}", False), (3, "none", True)], "query_id int, text string, has_gold_diff boolean")
    rows = E.score_answers(answers, ranks, ranks.where("query_id = 1"))
    got = E.summarize(rows).first()
    assert (got.n, got.hit_rate_at_k, got.mrr, got.produced_diff_rate, got.diff_validated_rate, got.patch_file_hit_rate) == (3, 0.667, 0.5, 0.667, 0.333, 0.5)
    failed = rows.withColumn("error", F.when(F.col("query_id") == 2, "boom"))
    assert E.summarize(failed, "error").first().hit_rate_at_k == 1.0
    ended = answers.withColumn("error", F.when(F.col("query_id") == 2, "boom")).withColumn("needs_human_review", F.col("query_id") == 3)
    kept = {r.query_id: r for r in E.score_answers(ended, ranks).collect()}
    assert (kept[2].error, kept[2].hit, kept[2].rr, kept[3].needs_human_review, kept[3].hit) == ("boom", None, None, True, True)
