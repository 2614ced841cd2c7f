"""Routing, verdict and consensus queries. Labels stand in for verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P
from ..operators import consensus as C
from . import data as D
from .registry import query

# A labelled document votes on its source: toxic objects, good agrees, the rest abstains; one in four does not own it.
_NOTES_SQL = f"""{D.TREE_SQL},
notes AS (SELECT source AS bug_id, doc_id AS note_no, {D.sql_layer('path')} AS layer,
  CASE WHEN toxic = 1 THEN 'DISAGREE' WHEN quality = 1 THEN 'AGREE' ELSE 'ABSTAIN' END AS verdict,
  doc_id % 4 <> 0 AS owns_layer, (size_bytes % 100) / 100.0 AS confidence, path AS target, lang AS reason
  FROM tree JOIN labels USING (doc_id))"""


def notes(spark, sf_dir):
    tree = D.source_tree(spark, sf_dir).drop("text")
    labels = D.table(spark, sf_dir, "labels")
    return tree.join(labels, "doc_id").select(
        F.col("source").alias("bug_id"),
        F.col("doc_id").alias("note_no"),
        P.guess_layer("path").alias("layer"),
        F.when(F.col("toxic") == 1, "DISAGREE").when(F.col("quality") == 1, "AGREE").otherwise("ABSTAIN").alias("verdict"),
        (F.col("doc_id") % 4 != 0).alias("owns_layer"),
        ((F.col("size_bytes") % 100) / 100.0).alias("confidence"),
        F.col("path").alias("target"),
        F.col("lang").alias("reason"),
    )


@query("consensus", f"""WITH {_NOTES_SQL},
vote AS (SELECT *, owns_layer AND verdict IN ('AGREE', 'DISAGREE') AS owner FROM notes),
tally AS (SELECT bug_id, count(*) FILTER (owner AND verdict = 'AGREE') AS agree, count(*) FILTER (owner AND verdict = 'DISAGREE') AS disagree,
  count(*) FILTER (NOT owner) AS abstain,
  round(coalesce(sum(CAST(confidence AS DOUBLE)) FILTER (owner AND verdict = 'AGREE'), 0), 9) AS wa,
  round(coalesce(sum(CAST(confidence AS DOUBLE)) FILTER (owner AND verdict = 'DISAGREE'), 0), 9) AS wd,
  arg_max(verdict, note_no) FILTER (layer = 'vss') AS own FROM vote GROUP BY bug_id),
judged AS (SELECT *, CASE WHEN wa + wd = 0 THEN 'weak' WHEN wd = 0 AND wa > 0 THEN 'agree' WHEN wa = 0 AND wd > 0 THEN 'reject'
  WHEN wa / (wa + wd) >= 0.67 THEN 'agree_with_dissent' ELSE 'conflict' END AS status FROM tally)
SELECT bug_id, status, agree, disagree, abstain, round(wa, 3) AS w_agree, round(wd, 3) AS w_disagree, agree + disagree AS total,
  status <> 'agree' OR coalesce(own = 'DISAGREE', false) AS force_human_review, wa = 0 AND wd > 0 AS reject_committed FROM judged""")
def consensus(spark, sf_dir):
    """Weighted vote per source; the layer committed to is `vss`."""
    n = notes(spark, sf_dir)
    committed = n.select("bug_id").distinct().withColumn("committed_layer", F.lit("vss"))
    votes = C.build_consensus(n, committed)
    return votes.select(
        "bug_id", "status", F.col("agree").cast("bigint"), F.col("disagree").cast("bigint"), F.col("abstain").cast("bigint"),
        "w_agree", "w_disagree", "total", "force_human_review", "reject_committed",
    )


_ANSWER_SQL = """answers AS (SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN '{"verdict": "' || v || '", "owns_layer": true, "confidence": ' || (n_chars % 150) / 100.0 || ', "target": "src/a.java", "reason": "r' || doc_id || '"}'
    WHEN 1 THEN 'Sure. ```json {"verdict": "' || lower(v) || '", "owns_layer": false} ```'
    WHEN 2 THEN 'I ' || v || ' with the target ' || doc_id
    WHEN 3 THEN 'This is outside my layer, so ' || v
    WHEN 4 THEN '{"verdict": "MAYBE", "owns_layer": true, "confidence": "high"}'
    ELSE '{broken ' || v || '}' END AS raw
  FROM (SELECT doc_id, n_chars, CASE WHEN toxic = 1 THEN 'DISAGREE' WHEN quality = 1 THEN 'AGREE' ELSE 'PARTIAL' END AS v
    FROM documents JOIN labels USING (doc_id)))"""


@query("specialist_verdicts", f"""WITH {_ANSWER_SQL},
body AS (SELECT doc_id, raw, regexp_extract(regexp_replace(raw, '```(?:json)?', '', 'g'), '(?s)\\{{.*\\}}') AS b FROM answers),
parsed AS (SELECT *, b <> '' AND json_valid(b) AS is_json, CASE WHEN b <> '' AND json_valid(b) THEN b::JSON END AS o,
  upper(regexp_extract(raw, '(?i)\\b(AGREE|DISAGREE|PARTIAL)\\b', 1)) AS word FROM body),
read AS (SELECT *, CASE WHEN is_json THEN upper(coalesce(o->>'verdict', '')) ELSE word END AS v0,
  CASE WHEN is_json THEN coalesce(o->>'owns_layer' = 'true', false)
    ELSE NOT regexp_matches(raw, '(?i)\\boutside (?:my|the)\\b|\\bnot my layer\\b') END AS owns_layer FROM parsed)
SELECT doc_id, owns_layer, CASE WHEN owns_layer AND v0 IN ('AGREE', 'DISAGREE') THEN v0 ELSE 'ABSTAIN' END AS verdict,
  CASE WHEN is_json THEN greatest(0.0, least(1.0, coalesce(try_cast(o->>'confidence' AS DOUBLE), 0.5))) ELSE 0.5 END AS confidence,
  CASE WHEN is_json THEN coalesce(o->>'target', '') ELSE '' END AS target,
  CASE WHEN is_json THEN coalesce(o->>'reason', '') ELSE substr(raw, 1, 200) END AS reason FROM read""")
def specialist_verdicts(spark, sf_dir):
    """Verdicts read from answers in six shapes: JSON, fenced JSON, free text, not-my-layer, odd values, broken JSON."""
    docs = D.documents(spark, sf_dir, "doc_id", "n_chars").join(D.table(spark, sf_dir, "labels"), "doc_id")
    v = F.when(F.col("toxic") == 1, "DISAGREE").when(F.col("quality") == 1, "AGREE").otherwise("PARTIAL")
    kind, number = F.col("doc_id") % 6, F.col("doc_id").cast("string")
    conf = ((F.col("n_chars") % 150) / 100.0).cast("string")
    raw = (
        F.when(kind == 0, F.concat(F.lit('{"verdict": "'), v, F.lit('", "owns_layer": true, "confidence": '), conf,
                                   F.lit(', "target": "src/a.java", "reason": "r'), number, F.lit('"}')))
        .when(kind == 1, F.concat(F.lit('Sure. ```json {"verdict": "'), F.lower(v), F.lit('", "owns_layer": false} ```')))
        .when(kind == 2, F.concat(F.lit("I "), v, F.lit(" with the target "), number))
        .when(kind == 3, F.concat(F.lit("This is outside my layer, so "), v))
        .when(kind == 4, F.lit('{"verdict": "MAYBE", "owns_layer": true, "confidence": "high"}'))
        .otherwise(F.concat(F.lit("{broken "), v, F.lit("}")))
    )
    return C.parse_verdicts(docs.select("doc_id", raw.alias("raw"))).drop("raw")


def _cases(blob: str, rules) -> str:
    return "[" + ", ".join(f"CASE WHEN {D.sql_contains_any(blob, words)} THEN '{layer}' END" for words, layer in rules) + "]"


@query("specialist_routing", f"""WITH {D.TREE_SQL},
wanted AS (SELECT doc_id, list_concat({_cases('lower(text)', fv.PRIORITY_KEYWORDS)}, [{D.sql_layer('path')}],
    {_cases('lower(path)', fv.PATH_LAYER_HINTS)}, {_cases('lower(text)', fv.KEYWORD_LAYERS)}) AS l FROM tree),
flat AS (SELECT doc_id, layer, min(pos) AS pos FROM (SELECT doc_id, unnest(l) AS layer, generate_subscripts(l, 1) AS pos FROM wanted)
  WHERE list_contains({D.sql_list(fv.SPECIALIST_LAYERS)}, layer) GROUP BY doc_id, layer)
SELECT doc_id, layer, CAST(n AS INT) AS n FROM (SELECT doc_id, layer, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM flat)""")
def specialist_routing(spark, sf_dir):
    """Specialists asked about every document: its text is the report, its path the committed file."""
    tree = D.source_tree(spark, sf_dir)
    layers = C.route_layers(F.col("text"), P.guess_layer("path"), F.array().cast("array<string>"), F.col("path"))
    return tree.select("doc_id", F.posexplode(layers).alias("n", "layer")).select("doc_id", "layer", (F.col("n") + 1).alias("n"))


_PACK_CASES = "[" + ", ".join(
    f"CASE WHEN list_contains({D.sql_list(layers)}, {D.sql_layer('path')}) OR {D.sql_contains_any('lower(text)', words)} "
    f"OR {D.sql_contains_any('lower(path)', parts)} THEN '{name}' END" for name, layers, words, parts, _ in fv.CONTEXT_PACKS
) + "]"


@query("context_packs", f"""WITH {D.TREE_SQL}
SELECT doc_id, coalesce(array_to_string(list_filter({_PACK_CASES}, lambda x: x IS NOT NULL), ','), '') AS packs FROM tree""")
def context_packs(spark, sf_dir):
    """Context packs of every document's specialist."""
    tree = D.source_tree(spark, sf_dir).withColumn("layer", P.guess_layer("path"))
    return tree.select("doc_id", F.array_join(C.context_packs(F.col("layer"), F.col("text"), F.col("path")), ",").alias("packs"))


_LAST_SQL = f"""{_NOTES_SQL}, last AS (SELECT bug_id, layer, arg_max(verdict, note_no) AS verdict, arg_max(owns_layer, note_no) AS owns_layer,
  arg_max(confidence, note_no) AS confidence, arg_max(target, note_no) AS target, arg_max(reason, note_no) AS reason FROM notes GROUP BY 1, 2)"""


@query("peer_briefs", f"""WITH {_LAST_SQL},
line AS (SELECT bug_id, layer, '- [' || layer || '] verdict=' || verdict || ' owns=' || CASE WHEN owns_layer THEN 'True' ELSE 'False' END
  || printf(' conf=%.2f', confidence) || ' target=' || target || ' :: ' || reason AS line FROM last),
pair AS (SELECT a.bug_id, a.layer, b.layer AS other, b.line FROM line a LEFT JOIN line b ON a.bug_id = b.bug_id AND a.layer <> b.layer)
SELECT bug_id, layer, coalesce(string_agg(line, chr(10) ORDER BY other), '') AS brief FROM pair GROUP BY 1, 2""")
def peer_briefs(spark, sf_dir):
    """What each specialist of a source is shown of the others; the latest note per layer counts."""
    fields = ["verdict", "owns_layer", "confidence", "target", "reason"]
    latest = notes(spark, sf_dir).groupBy("bug_id", "layer").agg(*[F.max_by(c, "note_no").alias(c) for c in fields])
    return C.peer_briefs(latest)
