"""Evidence and diagnosis queries: a conversation is a run, its turns are tool messages naming files of the tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import grounding as G
from ..plans import diagnosis as L
from ..workspace import written
from . import data as D
from .registry import query

# Each turn names the file of the document whose number is the conversation's plus the turn's, if there is one.
_MESSAGES_SQL = f"""{D.TREE_SQL},
messages AS (SELECT conv_id AS run_id, turn, c.text || coalesce(chr(10) || path || ' line 3', '') AS text, path
  FROM conversations c LEFT JOIN tree ON doc_id = conv_id + turn),
paths AS (SELECT DISTINCT run_id, path FROM messages WHERE path IS NOT NULL)"""


def messages(spark, sf_dir):
    """run_id, turn, text, path; path is null where a turn names no file."""
    turns = D.table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    tree = D.source_tree(spark, sf_dir).select("doc_id", "path")
    named = F.coalesce(F.concat(F.lit("\n"), "path", F.lit(" line 3")), F.lit(""))
    return turns.join(tree, F.col("doc_id") == F.col("conv_id") + F.col("turn"), "left").select(
        F.col("conv_id").alias("run_id"), "turn", F.concat("text", named).alias("text"), "path"
    )


@query("evidence_paths", f"WITH {_MESSAGES_SQL} SELECT run_id, path, {D.sql_layer('path')} AS layer FROM paths")
def evidence_paths(spark, sf_dir):
    """Distinct files named in the messages of each run, with their layer."""
    return G.evidence_paths(messages(spark, sf_dir))


# Proposals: the file of the first turn that names one, written exactly, with b/, by name only, not at all, or a file nobody
# saw; the first word of every turn as symbols, and the files of all turns as candidates.
_PROPOSAL_SQL = f"""{_MESSAGES_SQL},
words AS (SELECT run_id, list(word ORDER BY t) AS words FROM (SELECT run_id, regexp_extract(text, '[A-Za-z]+') AS word, min(turn) AS t FROM messages
  GROUP BY ALL) WHERE word <> '' GROUP BY run_id),
files AS (SELECT run_id, list(path ORDER BY turn) AS files FROM messages WHERE path IS NOT NULL GROUP BY run_id),
base AS (SELECT run_id, files[1] AS path, regexp_extract(files[1], '[^/]*$') AS name, files, list_transform(files, lambda f: {D.sql_layer('f')}) AS layers,
  coalesce(words, []) AS words FROM files LEFT JOIN words USING (run_id)),
claim AS (SELECT *, CASE run_id % 5 WHEN 0 THEN path WHEN 1 THEN 'b/' || path WHEN 2 THEN name WHEN 3 THEN '' ELSE 'no/such/file.java' END AS claim FROM base),
snap AS (SELECT c.*, CASE WHEN run_id % 5 IN (0, 1, 2) THEN path END AS snapped FROM claim c)"""


def proposals(spark, sf_dir, msgs):
    """run_id, raw: answers with a proposed diagnosis, one per run."""
    word = F.regexp_extract("text", "[A-Za-z]+", 0)
    in_turns = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("turn", name))), lambda one: one[name])
    runs = msgs.withColumn("word", word).groupBy("run_id").agg(  # the turns of one conversation
        F.array_compact(in_turns("path")).alias("files"), in_turns("word").alias("words")
    ).where(F.size("files") > 0).withColumn("path", F.element_at("files", 1))
    kind = F.col("run_id") % 5
    name = F.element_at(F.split("path", "/"), -1)
    claim = (
        F.when(kind == 0, F.col("path")).when(kind == 1, F.concat(F.lit("b/"), "path")).when(kind == 2, name)
        .when(kind == 3, F.lit("")).otherwise(F.lit("no/such/file.java"))
    )
    body = F.to_json(F.struct(
        claim.alias("file"),
        F.when(F.col("run_id") % 3 == 0, F.array_append("words", "NotThereManager")).otherwise(F.col("words")).alias("symbols"),
        F.array().cast("array<string>").alias("property_ids"),
        F.concat(F.lit("cause "), F.col("run_id").cast("string")).alias("root_cause"),
        F.array_append(
            F.transform("files", lambda one: F.struct(F.concat(F.lit("a/"), one).alias("path"), F.lit("seen").alias("why"))),
            F.struct(F.lit("no/where.c").alias("path"), F.lit("guess").alias("why")),
        ).alias("candidates"),
    ))
    return runs.select("run_id", F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```")).alias("raw"), claim.alias("claim"))


@query("snapped_paths", f"WITH {_PROPOSAL_SQL} SELECT run_id, claim, snapped FROM snap")
def snapped_paths(spark, sf_dir):
    """Claimed files snapped to the evidence."""
    msgs = messages(spark, sf_dir)
    return G.snap_paths(proposals(spark, sf_dir, msgs).select("run_id", "claim"), G.evidence_paths(msgs))


_COMMIT_SQL = f"""{_PROPOSAL_SQL},
judged AS (SELECT *, snapped IS NOT NULL AS committed, run_id % 3 = 0 AS odd,
    (CASE WHEN snapped IS NULL AND claim <> '' THEN 1 WHEN snapped IS NULL THEN 1 ELSE 0 END) + (CASE WHEN run_id % 3 = 0 THEN 1 ELSE 0 END) AS problems FROM snap)"""


@query("committed_diagnoses", f"""WITH {_COMMIT_SQL}
SELECT run_id, CASE WHEN committed THEN snapped ELSE claim END AS file, CASE WHEN committed THEN {D.sql_layer('snapped')} ELSE '' END AS layer,
  array_to_string(words, ',') AS symbols, 'cause ' || run_id AS root_cause, array_to_string(list_transform(files, lambda f, i: f || '|' || layers[i] || '|seen'), ',') AS candidates,
  CASE WHEN NOT committed THEN 'low' WHEN problems = 0 AND len(words) > 0 THEN 'high' ELSE 'medium' END AS confidence, CAST(problems AS INT) AS problems, committed FROM judged""")
def committed_diagnoses(spark, sf_dir):
    """Validated diagnosis of each run."""
    dx = _diagnoses(spark, sf_dir)
    entry = lambda c: F.concat_ws("|", c["path"], c["layer"], c["why"])
    return dx.select(
        "run_id", "file", "layer", F.array_join("symbols", ",").alias("symbols"), "root_cause",
        F.array_join(F.transform("candidates", entry), ",").alias("candidates"), "confidence",
        F.size("grounding_problems").alias("problems"), "committed",
    )


def _diagnoses(spark, sf_dir):
    msgs = written(messages(spark, sf_dir), "messages")
    return G.commit(proposals(spark, sf_dir, msgs), msgs, G.evidence_paths(msgs))


@query("review_flags", f"""WITH {_COMMIT_SQL}
SELECT run_id, NOT committed OR problems > 0 OR list_has_any(['native', 'vhal', 'vss', 'aidl', 'hidl_legacy', 'selinux', 'binder', 'startup_power', 'frameworks'], layers)
  OR regexp_matches(lower(CASE WHEN committed THEN snapped ELSE claim END), 'selinux|sepolicy|power') AS review FROM judged""")
def review_flags(spark, sf_dir):
    """Runs whose diagnosis a person has to see."""
    return _diagnoses(spark, sf_dir).select("run_id", G.needs_review().alias("review"))


@query("diagnosis_reports", f"""WITH {_COMMIT_SQL}
SELECT run_id, md5('## Candidate files (ranked)' || chr(10) || array_to_string(list_transform(files, lambda f, i: i || '. ' || f || ' [' || layers[i] || '] — seen'), chr(10)) || chr(10) || chr(10) || '## Root cause' || chr(10)
  || 'cause ' || run_id || CASE WHEN len(words) = 0 THEN '' ELSE chr(10) || chr(10) || '_Committed facts — symbols: ' || array_to_string(words, ', ') || '._' END || CASE WHEN problems = 0 THEN '' ELSE chr(10) || chr(10) || '> ⚠ Diagnosis grounding problems: '
  || array_to_string(list_filter([CASE WHEN committed THEN NULL WHEN claim <> '' THEN 'target file ''' || claim || ''' is not in the evidence — not grounded' ELSE 'no target file proposed' END,
    CASE WHEN odd THEN 'symbol ''NotThereManager'' not found in evidence — dropped' END], lambda x: x IS NOT NULL), '; ') END) AS digest FROM judged""")
def diagnosis_reports(spark, sf_dir):
    """Report text of each diagnosis."""
    return _diagnoses(spark, sf_dir).select("run_id", F.md5(G.render()).alias("digest"))


@query("relocation_hints", f"""WITH {D.TREE_SQL}
SELECT doc_id, 'CarPowerManager,Unit' || doc_id || 'Service' || CASE WHEN ends_with(path, '.yaml') THEN '' ELSE ',' || path END AS hints FROM tree""")
def relocation_hints(spark, sf_dir):
    """Names in objections; repeats in another spelling and the rejected file's own name are left out."""
    number = F.col("doc_id").cast("string")
    notes = F.concat(
        F.lit("DISAGREE target=- :: see CarPowerManager, Unit"), number, F.lit("Service, RejectedService and UNIT"), number,
        F.lit("Service in src/rejected.cpp or "), "path", F.lit(" ."),
    )
    tree = D.source_tree(spark, sf_dir).select("doc_id", "path", notes.alias("notes"))
    return tree.select("doc_id", F.array_join(X.relocation_hints("notes", F.lit("old/Rejected.java")), ",").alias("hints"))


@query("debate_rounds", f"""WITH {D.TREE_SQL},
seat AS (SELECT DISTINCT source AS bug_id, {D.sql_layer('path')} AS layer FROM tree),
bug AS (SELECT bug_id, count(*) AS seats, CAST(substr(bug_id, 4) AS INT) % 3 AS kind FROM seat GROUP BY bug_id)
SELECT bug_id, seats, CASE kind WHEN 0 THEN 'agree' WHEN 1 THEN 'reject' ELSE 'agree' END AS status,
  CASE kind WHEN 0 THEN 1 ELSE 2 END AS rounds FROM bug""")
def debate_rounds(spark, sf_dir):
    """Specialist rounds with recorded answers: one third agrees at once, one third keeps rejecting until its votes stand
    still, one third comes round after seeing its peers."""
    tree = D.source_tree(spark, sf_dir)
    seats = written(tree.select(F.col("source").alias("bug_id"), P.guess_layer("path").alias("layer")).distinct(), "seats")
    kind = F.regexp_extract("bug_id", r"(\d+)", 1).cast("int") % 3

    def recorded(wanted):
        says = F.when(kind == 0, "AGREE").when(kind == 1, "DISAGREE").when(F.col("round") == 1, "DISAGREE").otherwise("AGREE")
        return wanted.select("bug_id", "layer", F.format_string('{"verdict": "%s", "owns_layer": true, "confidence": 0.8}', says).alias("raw"))

    committed = seats.groupBy("bug_id").agg(F.min("layer").alias("committed_layer"))
    _, consensus = L.debate(seats, committed, recorded)
    return consensus.select("bug_id", F.col("total").alias("seats"), "status", "rounds")


@query("silent_voters", f"""WITH {D.TREE_SQL},
seat AS (SELECT DISTINCT source AS bug_id, {D.sql_layer('path')} AS layer FROM tree),
vote AS (SELECT bug_id, layer, CASE WHEN CAST(substr(bug_id, 4) AS INT) % 4 = 0 OR layer = 'native' THEN 'ABSTAIN'
  WHEN CAST(substr(bug_id, 4) AS INT) % 4 = 1 THEN 'DISAGREE' ELSE 'AGREE' END AS v FROM seat)
SELECT bug_id, count(*) FILTER (WHERE v = 'AGREE') AS agree, count(*) FILTER (WHERE v = 'DISAGREE') AS disagree,
  count(*) FILTER (WHERE v = 'ABSTAIN') AS abstain,
  CASE WHEN bool_or(v = 'AGREE') THEN 'agree' WHEN bool_or(v = 'DISAGREE') THEN 'reject' ELSE 'weak' END AS status,
  CASE WHEN bool_or(v = 'AGREE') THEN 1 ELSE 2 END AS rounds FROM vote GROUP BY bug_id""")
def silent_voters(spark, sf_dir):
    """Specialist rounds where one bug in four gets no answer, and the others none from the native seat."""
    tree = D.source_tree(spark, sf_dir)
    seats = written(tree.select(F.col("source").alias("bug_id"), P.guess_layer("path").alias("layer")).distinct(), "seats")
    kind = F.regexp_extract("bug_id", r"(\d+)", 1).cast("int") % 4

    def recorded(wanted):
        says = F.when(kind == 1, "DISAGREE").otherwise("AGREE")
        raw = F.format_string('{"verdict": "%s", "owns_layer": true, "confidence": 0.8}', says).alias("raw")
        return wanted.where((kind != 0) & (F.col("layer") != "native")).select("bug_id", "layer", raw)

    committed = seats.groupBy("bug_id").agg(F.min("layer").alias("committed_layer"))
    _, consensus = L.debate(seats, committed, recorded)
    return consensus.select("bug_id", "agree", "disagree", "abstain", "status", "rounds")


# Every second run has no candidates left and falls back on the files of its messages, in the order of the turns.
_FINAL_SQL = f"""{_COMMIT_SQL},
seen AS (SELECT run_id, string_agg(rank || '. ' || path || ' [' || {D.sql_layer('path')} || '] — retriever-ranked (score=' || printf('%.3f', 1.0 / rank) || ')', chr(10) ORDER BY rank) AS listed
  FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY turn) AS rank FROM messages WHERE path IS NOT NULL) WHERE rank <= 3 GROUP BY run_id)"""


@query("final_reports", f"""WITH {_FINAL_SQL}
SELECT run_id, run_id % 2 = 0 AS fallback, md5('## Candidate files (ranked)' || chr(10)
  || CASE WHEN run_id % 2 = 0 THEN listed ELSE array_to_string(list_transform(files, lambda f, i: i || '. ' || f || ' [' || layers[i] || '] — seen'), chr(10)) END || chr(10) || chr(10) || '## Root cause' || chr(10)
  || 'cause ' || run_id || CASE WHEN len(words) = 0 THEN '' ELSE chr(10) || chr(10) || '_Committed facts — symbols: ' || array_to_string(words, ', ') || '._' END || CASE WHEN problems = 0 THEN '' ELSE chr(10) || chr(10) || '> ⚠ Diagnosis grounding problems: '
  || array_to_string(list_filter([CASE WHEN committed THEN NULL WHEN claim <> '' THEN 'target file ''' || claim || ''' is not in the evidence — not grounded' ELSE 'no target file proposed' END,
    CASE WHEN odd THEN 'symbol ''NotThereManager'' not found in evidence — dropped' END], lambda x: x IS NOT NULL), '; ') END
  || CASE WHEN run_id % 3 = 1 THEN chr(10) || chr(10) || '## Patch' || chr(10) || 'patch ' || run_id || chr(10) || chr(10) || '> not verified' ELSE '' END) AS digest
FROM judged JOIN seen USING (run_id)""")
def final_reports(spark, sf_dir):
    """Finished reports: diagnosis with fallback candidates, and a patch for one run in three."""
    msgs = written(messages(spark, sf_dir), "messages")
    dx = G.commit(proposals(spark, sf_dir, msgs), msgs, G.evidence_paths(msgs))
    none = F.array().cast(G.CANDIDATES)
    dx = dx.withColumn("candidates", F.when(F.col("run_id") % 2 == 0, none).otherwise(F.col("candidates")))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy("turn"))
    hits = msgs.where("path IS NOT NULL").select("run_id", "path", rank.alias("rank")).withColumn("score", 1.0 / F.col("rank")).withColumn("layer", P.guess_layer("path"))
    wanted = dx.where("run_id % 3 = 1").select(F.col("run_id").alias("bug_id"))
    patches = wanted.select("bug_id", F.concat(F.lit("patch "), F.col("bug_id").cast("string")).alias("patch"), F.lit("not verified").alias("note"))
    return L.finalise(dx, hits, patches=patches, k=3).select("run_id", "fallback", F.md5("report").alias("digest"))
