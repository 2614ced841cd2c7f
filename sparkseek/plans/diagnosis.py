"""The loop around the operators: evidence, commit, specialist rounds, second search, report.

Language models are not part of this package. They enter as backends: functions that take a frame of prompts and give
back a frame of answers, typically recorded answers or a remote call inside an Arrow function. Without a backend the
step is skipped and says so; nothing is made up.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import first_diff
from ..operators import consensus as C
from ..operators import diffs as V
from ..operators import grounding as G
from ..workspace import written

# (votes wanted: bug_id, layer, round, brief) -> bug_id, layer, raw
Voter = Callable[[DataFrame], DataFrame]
# (patches wanted: bug_id, path, source, attempt, problem) -> bug_id, answer
Patcher = Callable[[DataFrame], DataFrame]


def debate(seats: DataFrame, committed: DataFrame, voter: Voter | None, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame] | None:
    """(notes, consensus) after rounds of voting, or none without a voter.

    `seats` has bug_id and layer; `committed` has bug_id and committed_layer. A bug leaves the loop when its votes did
    not change since the round before, when it reached an undisputed agreement, or after the last round. Each round is
    written, so the loop does not grow a plan and survives lost executors.
    """
    if voter is None:
        return None
    fields = ["bug_id", "layer", "verdict", "owns_layer", "confidence", "target", "reason", "round"]
    open_seats = seats.select("bug_id", "layer", F.lit("").alias("brief"))
    done, last = [], None
    for number in range(1, max(1, settings.loop.max_debate_rounds) + 1):
        answers = voter(open_seats.withColumn("round", F.lit(number))).select("bug_id", "layer", "raw")
        # A seat without an answer abstains.
        answers = open_seats.select("bug_id", "layer").join(answers, ["bug_id", "layer"], "left")
        notes = written(C.parse_verdicts(answers).withColumn("round", F.lit(number)).select(*fields), "notes")
        votes = C.build_consensus(notes.withColumn("note_no", F.lit(1)), committed)
        state = votes.select("bug_id", "status").join(C.verdict_map(notes), "bug_id")
        state = state.withColumn("verdicts", F.array_sort(F.map_entries("verdicts")))
        if last is not None:
            state = state.join(last.select("bug_id", F.col("verdicts").alias("_before")), "bug_id", "left")
        else:
            state = state.withColumn("_before", F.lit(None).cast(state.schema["verdicts"].dataType))
        stable = F.coalesce(F.col("_before") == F.col("verdicts"), F.lit(False))
        final = F.lit(number == settings.loop.max_debate_rounds)
        state = written(state.withColumn("closed", stable | (F.col("status") == "agree") | final), "debate")
        done.append(notes.join(state.where("closed").select("bug_id"), "bug_id", "left_semi"))
        going_on = state.where(~F.col("closed"))
        if going_on.isEmpty():
            break
        still = notes.join(going_on.select("bug_id"), "bug_id", "left_semi")
        open_seats, last = C.peer_briefs(still), going_on
    notes = done[0]
    for more in done[1:]:
        notes = notes.unionByName(more)
    rounds = notes.groupBy("bug_id").agg(F.max("round").alias("rounds"))
    consensus = C.build_consensus(notes.withColumn("note_no", F.lit(1)), committed).join(rounds, "bug_id")
    return notes, consensus


def wants_relocation(consensus: DataFrame, hints: DataFrame, passes: int = 0) -> DataFrame:
    """bug_id of bugs whose file all owners rejected while naming others; at most one second search."""
    rejected = consensus.where("reject_committed").select("bug_id")
    if passes >= 1:
        return rejected.limit(0)
    return rejected.join(hints.where(F.size("hints") > 0).select("bug_id"), "bug_id", "left_semi")


def continue_tools(steps: int, asked_for_tool: bool, settings: Settings = Settings()) -> bool:
    """Whether a reasoning loop goes on: the model asked for a tool and the step limit is not reached."""
    return asked_for_tool and steps < settings.loop.max_tool_steps


def patch_loop(targets: DataFrame, patcher: Patcher | None, settings: Settings = Settings(), parser=None, formatter=None) -> DataFrame | None:
    """bug_id, patch, note of each target (bug_id, path, text, symbols), or none without a patcher.

    A patch is asked for, applied in memory to the whole file and checked; a target whose patch fails, or for which no
    answer comes, is asked again with the problem, up to the configured number of further tries. The patcher sees
    `source`, the part of the file around the symbols. The note is empty only when everything was verified.
    """
    if patcher is None:
        return None
    window = V.symbol_window_udf(settings.loop.patch_context_chars)("text", "symbols")
    open_targets = written(
        targets.withColumn("_w", window).select(
            "bug_id", "path", "text", F.col("_w.text").alias("source"), F.lit(None).cast("string").alias("problem")
        ),
        "patch-targets",
    )
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    settled, tries = [], settings.loop.patch_max_tries + 1
    for attempt in range(1, tries + 1):
        answers = patcher(open_targets.withColumn("attempt", F.lit(attempt))).select("bug_id", "answer")
        tried = open_targets.drop("problem").join(answers, "bug_id", "left").withColumn("suffix", suffix)
        tried = tried.withColumn("patched", V.apply_diff_udf("text", first_diff("answer")))
        tried = tried.withColumn("syntax", V.check_syntax(F.col("patched"), F.col("suffix"), parser))
        tried = tried.withColumn("style", V.check_style(F.col("suffix"), formatter, F.col("text"), F.col("patched")))
        changes = F.contains("answer", F.lit("@@"))
        note = (
            F.when(F.col("answer").isNull(), F.lit(None))
            .when(~changes, "")
            .when(F.col("patched").isNull(), F.lit(None))
            .when(~F.col("syntax.ok"), F.lit(None))
            .when(~F.col("syntax.verified"), F.concat(F.lit("Syntax NOT verified: no parser for '"), F.col("suffix"), F.lit("'.")))
            .when(F.col("style") == "violations", F.lit(None))
            .when(F.col("style") == "unavailable", "Applies and parses, but style NOT enforced.")
            .otherwise("")
        )
        problem = (
            F.when(F.col("answer").isNull(), "no answer came.")
            .when(F.col("patched").isNull(), "the diff did not apply (a hunk's context did not match the file).")
            .when(~F.col("syntax.ok"), F.concat(F.lit("applying it introduces a syntax error — "), F.array_join("syntax.errors", "; ")))
            .otherwise("the added lines do not follow the style.")
        )
        judged = written(tried.select("bug_id", "path", "text", "source", F.col("answer").alias("patch"), note.alias("note"), problem.alias("problem")), "patches")
        settled.append(judged.where(F.col("note").isNotNull()).select("bug_id", "patch", "note"))
        failed = judged.where(F.col("note").isNull())
        if attempt == tries:
            warning = F.concat(F.lit("Generated patch still fails validation after retries: "), "problem", F.lit(" Verify on a real build."))
            settled.append(failed.select("bug_id", "patch", warning.alias("note")))
        elif failed.isEmpty():
            break
        open_targets = failed.select("bug_id", "path", "text", "source", "problem")
    result = settled[0]
    for more in settled[1:]:
        result = result.unionByName(more)
    return result


def finalise(diagnoses: DataFrame, hits: DataFrame, consensus: DataFrame | None = None, notes: DataFrame | None = None,
             patches: DataFrame | None = None, k: int | None = None) -> DataFrame:
    """One finished report per diagnosis: run_id, report, review, candidates, fallback.

    Diagnoses without candidates get the run's search hits, with k the best k (run_id, rank, path, layer, score). The report
    is the diagnosis, the consensus (bug_id, summary, force_human_review), the specialists' notes and the patch with its
    note, as far as there are any; drafts of diffs outside the patch are dropped.
    """
    rows = G.with_fallback_candidates(diagnoses, hits, k)
    flag, parts = F.lit(False), [G.render()]
    if consensus is not None:
        votes = consensus.select(F.col("bug_id").alias("run_id"), F.col("summary").alias("_summary"), F.col("force_human_review").alias("_force"))
        rows = rows.join(votes, "run_id", "left")
        flag = F.coalesce("_force", F.lit(False))
        parts.append(F.concat(F.lit("\n\n## Specialists\n"), F.col("_summary")))
    if notes is not None:
        blocks = C.render_notes(notes).withColumnRenamed("bug_id", "run_id").groupBy("run_id")
        rows = rows.join(blocks.agg(F.array_sort(F.collect_list(F.struct("layer", "text"))).alias("_notes")), "run_id", "left")  # one per layer
        parts.append(F.array_join(F.transform("_notes", lambda n: n["text"]), ""))
    text = F.concat(*[F.coalesce(part, F.lit("")) for part in parts])
    report = V.drop_drafts_udf(text, F.lit(None).cast("string"))["text"]
    if patches is not None:
        rows = rows.join(patches.select(F.col("bug_id").alias("run_id"), F.col("patch").alias("_patch"), F.col("note").alias("_note")), "run_id", "left")
        warning = F.when(F.col("_note") != "", F.concat(F.lit("\n\n> "), F.col("_note"))).otherwise("")
        report = F.concat(report, F.coalesce(F.concat(F.lit("\n\n## Patch\n"), F.col("_patch"), warning), F.lit("")))
        flag = flag | F.coalesce(F.col("_note") != "", F.lit(False))
    return rows.select("run_id", report.alias("report"), G.needs_review(flag).alias("review"), "candidates", "fallback")
