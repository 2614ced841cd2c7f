"""Checking proposed diagnoses against the evidence of a run.

Evidence stays in rows: `messages` (run_id, text) and `paths` (run_id, path). A run's messages are never glued into one
string, so a run with very many messages is no special case. Whether a token occurs in the evidence is decided message
by message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as X

CANDIDATES = "array<struct<path:string,layer:string,why:string>>"
PROPOSAL = "file string, symbols array<string>, property_ids array<string>, root_cause string, " \
           "candidates array<struct<path:string,why:string>>"


def evidence_messages(messages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """run_id, text: tool messages, and the text of each seed hit (run_id, path, content) with its path."""
    rows = messages.select("run_id", "text")
    if seeds is None:
        return rows
    folded = seeds.where(F.col("path") != "").select(
        "run_id", F.concat("path", F.lit("\n"), F.coalesce("content", F.lit(""))).alias("text")
    )
    return rows.unionByName(folded)


def evidence_paths(messages: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """run_id, path, layer: distinct paths of the evidence."""
    rows = messages.select("run_id", F.explode(X.mined_paths("text")).alias("path"))
    if seeds is not None:
        rows = rows.unionByName(seeds.where(F.col("path") != "").select("run_id", "path"))
    return rows.distinct().withColumn("layer", P.guess_layer("path"))


def json_object(raw) -> Column:
    """The outermost JSON object of an answer, null when there is none."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def parse_proposals(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds `p`: the proposed diagnosis in an answer; null when it holds no readable object."""
    return answers.withColumn("p", F.from_json(json_object(F.col(raw)), PROPOSAL))


def snap_paths(claims: DataFrame, paths: DataFrame) -> DataFrame:
    """`claims` (run_id, claim) plus `snapped`: the evidence path a claim means.

    Exactly, else without a leading a/ or b/, else the only evidence path with the same file name, else null.
    """
    known = paths.select("run_id", "path")
    wanted = claims.select("run_id", "claim").where(F.col("claim") != "").distinct()
    wanted = wanted.withColumn("bare", F.regexp_replace("claim", r"^[ab]/", "")).withColumn("name", F.substring_index("claim", "/", -1))
    by_name = known.groupBy("run_id", F.substring_index("path", "/", -1).alias("name")).agg(
        F.count("*").alias("_n"), F.min("path").alias("_only")
    )
    exact = known.withColumnRenamed("path", "claim").withColumn("_exact", F.lit(True))
    bare = known.withColumnRenamed("path", "bare").withColumn("_bare", F.lit(True))
    snapped = (
        wanted.join(exact, ["run_id", "claim"], "left")
        .join(bare, ["run_id", "bare"], "left")
        .join(by_name, ["run_id", "name"], "left")
        .select(
            "run_id",
            "claim",
            F.when(F.col("_exact"), F.col("claim")).when(F.col("_bare"), F.col("bare")).when(F.col("_n") == 1, F.col("_only")).alias("snapped"),
        )
    )
    return claims.join(snapped, ["run_id", "claim"], "left")


def grounded_tokens(tokens: DataFrame, messages: DataFrame) -> DataFrame:
    """run_id, token, found: whether some message of the run holds the token."""
    wanted = tokens.select("run_id", "token").where(F.col("token") != "").distinct()
    hits = (
        messages.join(wanted.groupBy("run_id").agg(F.collect_set("token").alias("_tokens")), "run_id")  # one answer's tokens
        .select("run_id", F.explode(F.filter("_tokens", lambda t: F.contains(F.col("text"), t))).alias("token"))
        .distinct()
        .withColumn("found", F.lit(True))
    )
    return wanted.join(hits, ["run_id", "token"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def commit(answers: DataFrame, messages: DataFrame, paths: DataFrame) -> DataFrame:
    """The validated diagnosis of each answer (run_id, raw; one answer per run).

    Columns: run_id, file, layer, symbols, property_ids, root_cause, candidates, confidence, grounding_problems, committed.
    """
    parsed = parse_proposals(answers).select(
        "run_id",
        X.strip(F.coalesce("p.file", F.lit(""))).alias("claim"),
        _trimmed("p.symbols").alias("symbols"),
        _trimmed("p.property_ids").alias("property_ids"),
        X.strip(F.coalesce("p.root_cause", F.lit(""))).alias("root_cause"),
        F.coalesce("p.candidates", F.array().cast("array<struct<path:string,why:string>>")).alias("proposed"),
    )
    listed = parsed.select("run_id", F.posexplode("proposed").alias("n", "c")).select(
        "run_id", "n", X.strip(F.coalesce("c.path", F.lit(""))).alias("claim"),
        X.strip(F.coalesce("c.why", F.lit(""))).alias("why"),
    )
    claims = snap_paths(parsed.select("run_id", "claim", F.lit(-1).alias("n"), F.lit("").alias("why")).unionByName(listed), paths)
    snapped = claims.groupBy("run_id").agg(  # the few paths of one answer
        F.max(F.when(F.col("n") == -1, F.col("snapped"))).alias("target"),
        F.transform(
            F.array_sort(F.collect_list(F.when((F.col("n") >= 0) & F.col("snapped").isNotNull(), F.struct("n", "snapped", "why")))),
            lambda c: F.struct(c["snapped"].alias("path"), P.guess_layer(c["snapped"]).alias("layer"), c["why"].alias("why")),
        ).alias("kept"),
    )
    tokens = parsed.select("run_id", F.explode(F.concat("symbols", "property_ids")).alias("token"))
    found = (
        grounded_tokens(tokens, messages).where("found").groupBy("run_id").agg(F.collect_set("token").alias("known"))
    )
    j = parsed.join(snapped, "run_id", "left").join(found, "run_id", "left")
    known = F.coalesce("known", F.array().cast("array<string>"))
    committed = F.col("target").isNotNull()
    missing = lambda column, kind: F.transform(
        F.filter(column, lambda t: ~F.array_contains(known, t)),
        lambda t: F.concat(F.lit(f"{kind} '"), t, F.lit("' not found in evidence — dropped")),
    )
    target_problem = (
        F.when(committed, F.array().cast("array<string>"))
        .when(F.col("claim") != "", F.array(F.concat(F.lit("target file '"), "claim", F.lit("' is not in the evidence — not grounded"))))
        .otherwise(F.array(F.lit("no target file proposed")))
    )
    problems = F.concat(target_problem, missing("symbols", "symbol"), missing("property_ids", "property_id"))
    target_entry = F.array(F.struct(F.col("target").alias("path"), P.guess_layer("target").alias("layer"), F.lit("committed target").alias("why")))
    kept = F.coalesce("kept", F.array().cast(CANDIDATES))
    named = F.exists(kept, lambda c: c["path"] == F.col("target"))
    grounded = lambda column: F.array_distinct(F.filter(column, lambda t: F.array_contains(known, t)))
    return j.select(
        "run_id",
        F.when(committed, F.col("target")).otherwise(F.col("claim")).alias("file"),
        F.when(committed, P.guess_layer("target")).otherwise(F.lit("")).alias("layer"),
        grounded("symbols").alias("symbols"),
        grounded("property_ids").alias("property_ids"),
        "root_cause",
        F.when(committed & ~named, F.concat(target_entry, kept)).otherwise(kept).cast(CANDIDATES).alias("candidates"),
        F.when(~committed, "low").when((F.size(grounded("symbols")) > 0) & (F.size(problems) == 0), "high").otherwise("medium").alias("confidence"),
        problems.alias("grounding_problems"),
        committed.alias("committed"),
    )


def _trimmed(column: str) -> Column:
    items = F.coalesce(F.col(column), F.array().cast("array<string>"))
    return F.filter(F.transform(items, lambda t: X.strip(t)), lambda t: t != "")


def with_fallback_candidates(diagnoses: DataFrame, hits: DataFrame, k: int | None = None) -> DataFrame:
    """Diagnoses whose candidates are empty get the run's search hits (run_id, rank, path, layer, score), with k the best k."""
    wanted = F.lit(True) if k is None else F.col("rank") <= k
    shown = hits.where(wanted & (F.col("path") != "")).groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "path", "layer", "score"))).alias("_hits")
    )
    fallback = F.transform(
        F.coalesce("_hits", F.array().cast("array<struct<rank:int,path:string,layer:string,score:double>>")),
        lambda h: F.struct(h["path"].alias("path"), h["layer"].alias("layer"),
                           F.format_string("retriever-ranked (score=%.3f)", h["score"]).alias("why")),
    )
    j = diagnoses.join(shown, "run_id", "left")
    empty = F.size("candidates") == 0
    return j.withColumn("fallback", empty & (F.size(fallback) > 0)).withColumn(
        "candidates", F.when(empty, fallback).otherwise(F.col("candidates")).cast(CANDIDATES)
    ).drop("_hits")


def needs_review(prior_flag: Column | None = None) -> Column:
    """Whether a person has to look at a diagnosis: ungrounded, problematic, or touching a sensitive layer or subject."""
    layers = F.array_append(F.transform("candidates", lambda c: c["layer"]), F.col("layer"))
    facts = F.lower(F.concat_ws(" ", "file", "root_cause"))
    return (
        (F.lit(False) if prior_flag is None else prior_flag)
        | ~F.col("committed")
        | (F.size("grounding_problems") > 0)
        | F.arrays_overlap(layers, F.array(*[F.lit(l) for l in fv.ALWAYS_REVIEW_LAYERS]))
        | P.contains_any(facts, fv.REVIEW_WORDS)
    )


def render() -> Column:
    """The report text of a diagnosis."""
    lines = F.transform(
        "candidates",
        lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), c["path"], F.lit(" ["), c["layer"], F.lit("]"),
                              F.when(c["why"] != "", F.concat(F.lit(" — "), c["why"])).otherwise(F.lit(""))),
    )
    facts = F.array_compact(F.array(
        F.when(F.size("symbols") > 0, F.concat(F.lit("symbols: "), F.array_join("symbols", ", "))),
        F.when(F.size("property_ids") > 0, F.concat(F.lit("property ids: "), F.array_join("property_ids", ", "))),
    ))
    return F.concat(
        F.lit("## Candidate files (ranked)\n"),
        F.when(F.size("candidates") > 0, F.array_join(lines, "\n")).otherwise(F.lit("_(none grounded in evidence)_")),
        F.lit("\n\n## Root cause\n"),
        F.when(F.col("root_cause") != "", F.col("root_cause")).otherwise(F.lit("_(not committed)_")),
        F.when(F.size(facts) > 0, F.concat(F.lit("\n\n_Committed facts — "), F.array_join(facts, "; "), F.lit("._"))).otherwise(F.lit("")),
        F.when(F.size("grounding_problems") > 0, F.concat(
            F.lit("\n\n> ⚠ Diagnosis grounding problems: "), F.array_join("grounding_problems", "; ")
        )).otherwise(F.lit("")),
    )
