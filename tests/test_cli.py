import json
import subprocess

from sparkseek import cli
from sparkseek.config import Settings


def test_index_report_evaluate(spark, tmp_path):
    root, stores = tmp_path / "src", str(tmp_path / "stores")
    (root / "vendor/oem").mkdir(parents=True)
    (root / "vendor/oem/Speed.java").write_text("class Speed {\n  int readVehicleSpeed() { return 0; }\n}\n")
    (root / "vendor/oem/Door.java").write_text("class Door {\n  void openDoor() { }\n}\n")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q"), git("add", "."), git("commit", "-qm", "one")
    settings = Settings()
    parse = lambda name, *more: cli._parser().parse_args([name, "--source-root", str(root), "--stores-root", stores, "--customer", "oem", *more])
    first = cli.run_index(spark, parse("index"), settings)
    assert first.count == 2 and first.git_sha

    (root / "vendor/oem/Door.java").write_text("class Door {\n  void openDoor() { }\n  void closeDoor() { }\n}\n")
    git("add", "."), git("commit", "-qm", "two")
    second = cli.run_index(spark, parse("index", "--incremental"), settings)
    assert second.count == 2 and second.git_sha != first.git_sha
    lines = [r.line for r in cli.run_search(spark, parse("search", "--query", "closeDoor"), settings).collect()]
    assert "vendor/oem/Door.java" in lines[0]

    bugs = tmp_path / "labels.jsonl"
    bugs.write_text("\n".join(json.dumps(b) for b in (
        {"id": "a", "bug": "readVehicleSpeed is stale", "gold_files": ["vendor/oem/Speed.java"], "gold_diff_files": ["vendor/oem/Speed.java"]},
        {"id": "b", "bug": "openDoor fails", "gold_files": ["vendor/oem/Door.java"]})))
    answers = tmp_path / "answers.jsonl"
    patch = "1. vendor/oem/Speed.java\n--- a/vendor/oem/Speed.java\n+++ b/vendor/oem/Speed.java\n@@ -1 +1 @@\n-x\n+y"
    answers.write_text(json.dumps({"id": "a", "answer": json.dumps({"file": "vendor/oem/Speed.java", "symbols": ["readVehicleSpeed"], "root_cause": "stale"})}))
    out = str(tmp_path / "out")
    reports = {r.run_id: r for r in cli.run_report(spark, parse("report", "--labels", str(bugs), "--answers", str(answers), "--out", out), settings).collect()}
    assert "vendor/oem/Speed.java" in reports["a"].report and "stale" in reports["a"].report
    assert reports["b"].review and "retriever-ranked" in reports["b"].report  # no answer, no bug lost
    answers.write_text(json.dumps({"id": "a", "answer": patch}))
    summary = cli.run_evaluate(spark, parse("evaluate", "--labels", str(bugs), "--answers", str(answers), "--out", out), settings).first()
    assert (summary.n, summary.hit_rate_at_k, summary.produced_diff_rate, summary.patch_file_hit_rate) == (2, 0.5, 0.5, 1.0)
    answers.write_text("\n".join(json.dumps(a) for a in (
        {"id": "a", "answer": patch, "verified_candidates": ["vendor/oem/Speed.java"], "needs_human_review": True}, {"id": "b", "error": "timed out"})))
    failed = cli.run_evaluate(spark, parse("evaluate", "--labels", str(bugs), "--answers", str(answers), "--out", out), settings).first()
    assert (failed.n, failed.n_scored, failed.hit_rate_at_k) == (2, 1, 1.0)
    rows = {r.query_id: r for r in spark.read.json(f"{out}/rows").collect()}
    assert (rows["a"].verified_candidates, rows["a"].needs_human_review, rows["b"].error, rows["b"].hit) == (["vendor/oem/Speed.java"], True, "timed out", None)
    searched = cli.run_evaluate(spark, parse("evaluate", "--labels", str(bugs), "--out", out), settings).first()
    assert searched.hit_rate_at_k == 1.0
