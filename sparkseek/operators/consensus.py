"""Specialist routing, verdict parsing and the weighted vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import paths as P
from ..functions import text as X


def _tagged(blob: Column, rules) -> list[Column]:
    return [F.when(P.contains_any(blob, words), F.lit(layer)) for words, layer in rules]


def route_layers(report, layer, candidate_layers, path_blob, max_layers: int | None = None) -> Column:
    """Layers whose specialists look at a bug, strongest reason first; with a number that many at most.

    Priority words of the report, the committed layer, candidate layers, path hints, then other words of the report.
    `path_blob` is the text of all paths concerned.
    """
    q, paths = F.lower(F.coalesce(report, F.lit(""))), F.lower(F.coalesce(path_blob, F.lit("")))
    wanted = F.concat(
        P.bound(q, lambda x: F.array(*_tagged(x, fv.PRIORITY_KEYWORDS))),
        F.array(layer),
        F.coalesce(candidate_layers, F.array().cast("array<string>")),
        P.bound(paths, lambda x: F.array(*_tagged(x, fv.PATH_LAYER_HINTS))),
        P.bound(q, lambda x: F.array(*_tagged(x, fv.KEYWORD_LAYERS))),
    )
    known = F.filter(wanted, lambda l: l.isin(*fv.SPECIALIST_LAYERS))
    layers = F.array_distinct(known)
    return layers if max_layers is None else F.slice(layers, 1, max_layers)


def context_packs(layer, report, path_blob) -> Column:
    """Names of the context packs that apply to a specialist, in fixed order."""
    q, paths = F.lower(F.coalesce(report, F.lit(""))), F.lower(F.coalesce(path_blob, F.lit("")))
    packs = [
        F.when(layer.isin(*layers) | P.contains_any(q, words) | P.contains_any(paths, parts), F.lit(name))
        for name, layers, words, parts, _ in fv.CONTEXT_PACKS
    ]
    return F.array_compact(F.array(*packs))


def first_verdict(text) -> Column:
    """AGREE or DISAGREE when that is the first verdict word of a text, else ABSTAIN."""
    word = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)\b(AGREE|DISAGREE|PARTIAL)\b", 1))
    return F.when(word.isin("AGREE", "DISAGREE"), word).otherwise(F.lit("ABSTAIN"))


VERDICT = "verdict string, owns_layer string, confidence string, target string, reason string"
_FALSY = ("false", "0", "0.0", "", "[]", "{}")


def parse_verdicts(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds verdict, owns_layer, confidence, target, reason read from an answer.

    A JSON object is taken as it is, with unknown verdicts abstaining and the confidence clamped to [0, 1]. Anything
    else is read as free text. Who does not own the layer abstains.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    body = F.nullif(F.regexp_extract(F.regexp_replace(text, "```(?:json)?", ""), r"(?s)\{.*\}", 0), F.lit(""))
    obj = F.from_json(body, VERDICT + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    parsed = answers.withColumn("_o", obj)
    is_json = F.col("_o").isNotNull() & F.col("_o._bad").isNull()
    claimed = F.upper(X.strip(F.coalesce("_o.verdict", F.lit(""))))
    owns_json = F.coalesce(~F.lower("_o.owns_layer").isin(*_FALSY), F.lit(False))
    owns_text = ~text.rlike(r"(?i)\boutside (?:my|the)\b|\bnot my layer\b")
    confidence = F.when(F.col("_o.confidence").isNull(), F.lit(0.5)).otherwise(
        F.coalesce(F.expr("try_cast(_o.confidence AS double)"), F.lit(0.5))
    )
    owns = F.when(is_json, owns_json).otherwise(owns_text)
    verdict = F.when(is_json, F.when(claimed.isin("AGREE", "DISAGREE", "ABSTAIN"), claimed).otherwise("ABSTAIN")).otherwise(first_verdict(text))
    return parsed.select(
        *answers.columns,
        F.when(owns, verdict).otherwise(F.lit("ABSTAIN")).alias("verdict"),
        owns.alias("owns_layer"),
        F.when(is_json, F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(is_json, X.strip(F.coalesce("_o.target", F.lit("")))).otherwise(F.lit("")).alias("target"),
        F.when(is_json, X.strip(F.coalesce("_o.reason", F.lit("")))).otherwise(X.strip(text)).alias("reason"),
    )


def build_consensus(notes: DataFrame, committed: DataFrame | None = None, keys: list[str] = ("bug_id",)) -> DataFrame:
    """Confidence-weighted vote of the owning specialists per bug.

    `notes` has the keys, layer, verdict, owns_layer, confidence and `note_no` (order of the notes); `committed` has the
    keys and committed_layer. Votes are first summed per bug and layer, so a bug with very many notes is summed in parts.
    """
    keys = list(keys)
    owner = F.col("owns_layer") & F.col("verdict").isin("AGREE", "DISAGREE")
    agree, disagree = owner & (F.col("verdict") == "AGREE"), owner & (F.col("verdict") == "DISAGREE")
    weight = F.coalesce("confidence", F.lit(0.5)).cast("double")
    per_layer = notes.groupBy(*keys, "layer").agg(
        F.count_if(agree).alias("_a"),
        F.count_if(disagree).alias("_d"),
        F.count_if(~owner).alias("_x"),
        F.sum(F.when(agree, weight).otherwise(0.0)).alias("_wa"),
        F.sum(F.when(disagree, weight).otherwise(0.0)).alias("_wd"),
        F.max_by("verdict", "note_no").alias("_v"),
    )
    votes = per_layer.groupBy(*keys).agg(
        F.sum("_a").alias("agree"),
        F.sum("_d").alias("disagree"),
        F.sum("_x").alias("abstain"),
        F.round(F.sum("_wa"), 9).alias("_wa"),
        F.round(F.sum("_wd"), 9).alias("_wd"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("layer", F.lit("")), "_v")))).alias("by_layer"),  # one per layer
    )
    if committed is not None:
        votes = votes.join(committed, keys, "left")
    else:
        votes = votes.withColumn("committed_layer", F.lit(""))
    wa, wd = F.col("_wa"), F.col("_wd")
    status = (
        F.when(wa + wd == 0, "weak")
        .when((wd == 0) & (wa > 0), "agree")
        .when((wa == 0) & (wd > 0), "reject")
        .when(wa / (wa + wd) >= 0.67, "agree_with_dissent")
        .otherwise("conflict")
    )
    own = F.try_element_at("by_layer", F.coalesce("committed_layer", F.lit("")))
    return votes.withColumn("status", status).select(
        *keys,
        "status",
        "agree",
        "disagree",
        "abstain",
        F.round(wa, 3).alias("w_agree"),
        F.round(wd, 3).alias("w_disagree"),
        (F.col("agree") + F.col("disagree")).alias("total"),
        "by_layer",
        ((F.col("status") != "agree") | F.coalesce(own == "DISAGREE", F.lit(False))).alias("force_human_review"),
        ((wa == 0) & (wd > 0)).alias("reject_committed"),
        F.format_string(
            "consensus=%s AGREE=%d(w%.2f) DISAGREE=%d(w%.2f) ABSTAIN=%d (n=%d)",
            F.col("status"), F.col("agree"), wa, F.col("disagree"), wd, F.col("abstain"),
            F.col("agree") + F.col("disagree") + F.col("abstain"),
        ).alias("summary"),
    )


def note_line() -> Column:
    """One specialist's note as its peers see it."""
    return F.format_string(
        "- [%s] verdict=%s owns=%s conf=%.2f target=%s :: %s",
        F.col("layer"), F.col("verdict"), F.initcap(F.col("owns_layer").cast("string")), F.col("confidence"),
        F.when(F.coalesce("target", F.lit("")) == "", "-").otherwise(F.col("target")),
        F.coalesce("reason", F.lit("")),
    )


def peer_briefs(notes: DataFrame, key: str = "bug_id") -> DataFrame:
    """key, layer, brief: for each specialist the notes of all others. One note per bug and layer."""
    lines = notes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("layer", note_line().alias("line")))).alias("_lines"))
    others = F.filter("_lines", lambda n: n["layer"] != F.col("layer"))
    return notes.select(key, "layer").join(lines, key).select(
        key, "layer", F.array_join(F.transform(others, lambda n: n["line"]), "\n").alias("brief")
    )


def verdict_map(notes: DataFrame, key: str = "bug_id") -> DataFrame:
    """key, verdicts: layer -> (verdict, owns_layer). One note per bug and layer."""
    entry = F.struct("layer", F.struct("verdict", "owns_layer"))
    return notes.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("verdicts"))


def render_notes(notes: DataFrame, key: str = "bug_id") -> DataFrame:
    """key, layer, text: the report block of each specialist."""
    text = F.format_string(
        "\n## [%s] %s (owns=%s, conf=%.2f)\ntarget: %s\n%s",
        F.col("layer"), F.col("verdict"), F.initcap(F.col("owns_layer").cast("string")), F.col("confidence"),
        F.when(F.coalesce("target", F.lit("")) == "", "-").otherwise(F.col("target")), F.coalesce("reason", F.lit("")),
    )
    return notes.select(key, "layer", text.alias("text"))
