"""Command line: build or refresh a store, search it, report on and evaluate labelled bugs with recorded answers."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .batches import bound_batches
from .config import Settings, load_settings
from .functions import text as X
from .operators import evaluation as E
from .operators import grounding as G
from .plans import indexing
from .plans.diagnosis import finalise
from .plans.search import HybridSearch, search_line
from .shipping import ship
from .sources import changes, files, labels, stores
from .workspace import clear, written


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sparkseek")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("index", "search", "report", "evaluate"):
        c = commands.add_parser(name)
        c.add_argument("--source-root", required=name == "index")
        c.add_argument("--stores-root", required=True)
        c.add_argument("--config")
        c.add_argument("--customer")
        c.add_argument("--project", default="default")
        c.add_argument("--version", default="aosp15")
        c.add_argument("--scope")
        if name == "index":
            c.add_argument("--base", action="store_true")
            c.add_argument("--incremental", action="store_true")
            c.add_argument("--reset", action="store_true")
        if name == "search":
            c.add_argument("--query", required=True)
            c.add_argument("--top-k", type=int)
        if name in ("report", "evaluate"):
            c.add_argument("--labels", required=True)
            c.add_argument("--answers", required=name == "report", help="JSON lines: id, answer")
            c.add_argument("--k", type=int, default=5)
            c.add_argument("--out", required=True)
    return parser


def run_index(spark: SparkSession, args, settings: Settings) -> stores.Manifest:
    if not args.base and not args.customer:
        raise SystemExit("name a store: --base or --customer")
    provider = stores.StoreProvider(spark, args.stores_root, settings.retrieval.embed_model)
    folder = provider.folder(base=args.base, tenant=stores.Tenant(args.customer or "base", args.project, args.version))
    mode = "base" if args.base else "customer"
    before = stores.read_manifest(spark, folder)
    head = changes.git_head(args.source_root)
    again = args.incremental and not args.reset and before is not None
    roots = (before.index_roots if again and before.index_roots else None) or settings.scope_roots(args.scope)
    tree = files.scan_tree(spark, args.source_root, mode, roots)
    if again:
        # Commits say what changed; without them, or when git can't tell, digests do.
        known = changes.git_changes(spark, args.source_root, before.git_sha, head) if before.git_sha and head else None
        return indexing.refresh_store(tree, folder, mode, settings, known, head, args.scope)
    return indexing.build_store(tree, folder, mode, settings, args.scope, head)


def _search(spark: SparkSession, args, settings: Settings) -> HybridSearch:
    provider = stores.StoreProvider(spark, args.stores_root, settings.retrieval.embed_model)
    tenant = stores.resolve_tenant(provider, args.customer, args.project, args.version, settings.retrieval.default_customer)
    store = provider.open(tenant) if tenant else stores.open_flat(spark, args.stores_root)
    tree = None
    if args.source_root:
        roots = store.index_roots() or settings.scope_roots(args.scope)
        tree = files.scan_tree(spark, args.source_root, "customer", roots).select("path", "text")
    return HybridSearch(store, tree, settings)


def run_search(spark: SparkSession, args, settings: Settings):
    queries = spark.range(1).select(F.lit("q").alias("query_id"), F.lit(args.query).alias("query"))
    return _search(spark, args, settings).search(queries, args.top_k).orderBy("rank").select(search_line().alias("line"))


def _hits(spark: SparkSession, args, settings: Settings, bugs):
    report = F.concat_ws("\n", "bug", F.coalesce("logcat", F.lit("")))
    return _search(spark, args, settings).search(bugs.select(F.col("id").alias("query_id"), report.alias("query")))


def run_report(spark: SparkSession, args, settings: Settings):
    """One finished report per bug: what its recorded answer proposes, checked against the hits of its search."""
    bugs = labels.read_labels(spark, args.labels)
    hits = written(_hits(spark, args, settings, bugs).withColumnRenamed("query_id", "run_id"), "report-hits")
    answers = bugs.select(F.col("id").alias("run_id")).join(labels.read_answers(spark, args.answers).withColumnsRenamed({"id": "run_id", "answer": "raw"}), "run_id", "left")
    none = hits.select("run_id", F.lit("").alias("text")).limit(0)
    evidence, paths = G.evidence_messages(none, hits), G.evidence_paths(none, hits)
    reports = finalise(G.commit(answers, evidence, paths), hits)
    reports.write.mode("overwrite").json(args.out)
    return reports.select("run_id", "review", "report")


def run_evaluate(spark: SparkSession, args, settings: Settings):
    """Ranks come from the recorded answers where there are any, else from the search."""
    bugs = labels.read_labels(spark, args.labels)
    recorded = labels.read_answers(spark, args.answers) if args.answers else None
    asked = bugs.select(F.col("id").alias("query_id"), (F.coalesce(F.size("gold_diff_files"), F.lit(0)) > 0).alias("has_gold_diff"))
    if recorded is None:
        ranked, answers, patched = _hits(spark, args, settings, bugs), asked.withColumn("text", F.lit("")), None
    else:
        answers = asked.join(recorded.withColumnsRenamed({"id": "query_id", "answer": "text"}), "query_id", "left")
        answers = written(answers.withColumn("text", F.coalesce("text", F.lit(""))), "answers")
        listed = lambda paths: answers.select("query_id", F.posexplode(paths).alias("rank", "path")).withColumn("rank", F.col("rank") + 1)
        ranked, patched = listed(X.ranked_paths("text")), listed(X.diff_targets("text"))
    patch_ranks = E.gold_ranks(patched, labels.gold(bugs, "gold_diff_files")) if patched is not None else None
    rows = E.score_answers(answers, E.gold_ranks(ranked, labels.gold(bugs), args.k), patch_ranks)
    summary = E.summarize(rows, "error" if "error" in rows.columns else None)
    labels.write_results(rows, summary, args.out)
    return summary


def main(argv=None) -> None:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkseek").getOrCreate()
    ship(spark)
    bound_batches(spark)
    settings = load_settings(args.config)
    try:
        _run(spark, args, settings)
    finally:
        clear(spark)


def _run(spark: SparkSession, args, settings: Settings) -> None:
    result = {"index": run_index, "search": run_search, "report": run_report, "evaluate": run_evaluate}[args.command](spark, args, settings)
    print(result) if args.command == "index" else result.show(truncate=False)


if __name__ == "__main__":
    main()
