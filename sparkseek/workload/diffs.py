"""Diff queries: every document gets a patch of its second line; one in three patches does not fit."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import text as X
from ..operators import diffs as V
from ..operators.line_difference import changed_ranges_udf
from ..plans import diagnosis as L
from ..workspace import written
from . import data as D
from .registry import query

# The patch replaces line two and adds a line behind it; on a document of one line it can't fit.
_PATCH_SQL = f"""{D.TREE_SQL},
lines AS (SELECT doc_id, path, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM tree),
patched AS (SELECT *, coalesce(l[2], '') AS l2, CASE WHEN doc_id % 3 = 0 THEN coalesce(l[2], '') || ' gone' ELSE coalesce(l[2], '') END AS old FROM lines)"""


def patches(spark, sf_dir):
    """doc_id, path, text, patch."""
    tree = D.source_tree(spark, sf_dir).select("doc_id", "path", "text")
    rows = tree.withColumn("l", X.split_lines("text"))
    first, second = F.get("l", F.lit(0)), F.coalesce(F.get("l", F.lit(1)), F.lit(""))
    old = F.when(F.col("doc_id") % 3 == 0, F.concat(second, F.lit(" gone"))).otherwise(second)
    patch = F.concat(
        F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n@@ -1,2 +1,3 @@\n "), first, F.lit("\n-"), old,
        F.lit("\n+"), second, F.lit(" fixedValue\n+added MAX_SPEED\n"),
    )
    return rows.select("doc_id", "path", "text", patch.alias("patch"))


@query("applied_diffs", f"""WITH {_PATCH_SQL}
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 AND len(l) > 1 THEN md5(array_to_string(list_concat([l[1], l2 || ' fixedValue', 'added MAX_SPEED'], l[3:]), chr(10))) END AS digest FROM patched""")
def applied_diffs(spark, sf_dir):
    """Text of every document after its patch; null where the patch does not fit."""
    rows = patches(spark, sf_dir)
    return rows.select("doc_id", F.md5(V.apply_diff_udf("text", "patch")).alias("digest"))


_TRIM = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query("diff_problems", f"""WITH {_PATCH_SQL},
asked AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN path || '.gone' ELSE path END AS path, l,
    array_to_string(list_filter([{_TRIM.format(x='l[1]')}, {_TRIM.format(x='old')}], lambda x: x <> ''), chr(10)) AS block FROM patched),
whole AS (SELECT doc_id, array_to_string(list_transform(l, lambda x: {_TRIM.format(x='x')}), chr(10)) AS body FROM patched)
SELECT doc_id, 0 AS hunk_no, CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN block <> '' AND NOT contains(body, block) THEN 'mismatch' ELSE 'fits' END AS verdict
FROM asked JOIN whole USING (doc_id)""")
def diff_problems(spark, sf_dir):
    """Check of every patch against the real file; one in five names a file that does not exist."""
    rows = patches(spark, sf_dir)
    target = F.when(F.col("doc_id") % 5 == 0, F.replace("patch", F.concat(F.lit("/"), F.element_at(F.split("path", "/"), -1)),
                    F.concat(F.lit("/"), F.element_at(F.split("path", "/"), -1), F.lit(".gone")))).otherwise(F.col("patch"))
    checked = V.check_diffs(rows.select("doc_id", target.alias("text")), rows.select("path", "text"))
    verdict = F.when(F.col("problem").isNull(), "fits").when(F.contains("problem", F.lit("not found")), "missing").otherwise("mismatch")
    return checked.select("doc_id", "hunk_no", verdict.alias("verdict"))


@query("diff_hunks", f"""WITH {_PATCH_SQL}
SELECT doc_id, 0 AS hunk_no, path, array_to_string(list_filter([{_TRIM.format(x='l[1]')}, {_TRIM.format(x='old')}], lambda x: x <> ''), chr(10)) AS block FROM patched""")
def diff_hunks(spark, sf_dir):
    """The lines each hunk replaces."""
    return V.diff_hunks(patches(spark, sf_dir).select("doc_id", F.col("patch").alias("text")))


_NAME = "[A-Za-z_][A-Za-z0-9_]{2,}"


@query("test_consistency", f"""WITH {_PATCH_SQL},
sides AS (SELECT doc_id, text || CASE WHEN doc_id % 5 = 0 THEN ' WRONG_ID' ELSE '' END AS source,
    l2 || ' fixedValue' || chr(10) || 'added ' || CASE WHEN doc_id % 7 = 0 THEN 'MAX_POWER' ELSE 'MAX_SPEED' END AS added,
    CASE WHEN doc_id % 2 = 0 THEN 'TEST_F(X) ' || l[1] || ' WRONG_ID' ELSE 'fixedValue MAX_SPEED' END AS test FROM patched),
names AS (SELECT doc_id, test, list_distinct(regexp_extract_all(source, '{_NAME}')) AS s, list_distinct(regexp_extract_all(added, '{_NAME}')) AS a,
    list_distinct(regexp_extract_all(test, '{_NAME}')) AS t FROM sides),
kept AS (SELECT *, list_sort(list_filter(a, lambda n: length(n) > 3 AND NOT list_contains({D.sql_list(fv.TEST_SCAFFOLD_NAMES)}, n))) AS patched FROM names)
SELECT doc_id, array_to_string(patched, ',') AS patched, len(patched) > 0 AND NOT list_has_any(patched, t) AS unrelated,
  list_contains(t, 'WRONG_ID') AND NOT list_contains(s, 'WRONG_ID') AND NOT list_contains(a, 'WRONG_ID') AS wrong_id_unknown,
  list_contains(t, 'MAX_SPEED') AND NOT list_contains(s, 'MAX_SPEED') AND NOT list_contains(a, 'MAX_SPEED') AS max_speed_unknown FROM kept""")
def test_consistency(spark, sf_dir):
    """Whether a test of each patch names what the patch adds, and uses constants nobody defines: one source in five defines
    the constant of every second test, one patch in seven doesn't add that of the others."""
    doc = F.col("doc_id")
    rows = patches(spark, sf_dir).withColumn("patch", F.when(doc % 7 == 0, F.replace("patch", F.lit("added MAX_SPEED"), F.lit("added MAX_POWER"))).otherwise(F.col("patch")))
    test = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("TEST_F(X) "), F.element_at(X.split_lines("text"), 1), F.lit(" WRONG_ID"))
    ).otherwise(F.lit("fixedValue MAX_SPEED"))
    rows = rows.withColumn("test", test).withColumn("text", F.when(doc % 5 == 0, F.concat("text", F.lit(" WRONG_ID"))).otherwise(F.col("text")))
    judged = rows.withColumn("c", V.test_consistency("text", "patch", "test"))
    return judged.select(
        "doc_id",
        F.array_join("c.patched", ",").alias("patched"),
        F.col("c.unrelated").alias("unrelated"),
        F.array_contains("c.unknown", "WRONG_ID").alias("wrong_id_unknown"),
        F.array_contains("c.unknown", "MAX_SPEED").alias("max_speed_unknown"),
    )


# An edited document: line after line, one in five goes, one in seven gets a mark, and a marked line follows one in eleven.
# A marked line equals no other line, so a shortest edit script keeps all lines without a mark.
_EDITED_SQL = f"""{_PATCH_SQL},
numbered AS (SELECT doc_id, n, l[n] AS line, (n + doc_id) % 5 = 0 AS gone, (n + doc_id) % 7 = 0 AS marked, (n * doc_id) % 11 = 3 AS followed
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM patched)),
edited AS (
  SELECT doc_id, n, 0 AS place, CASE WHEN marked THEN line || ' mark' || n ELSE line END AS line, marked FROM numbered WHERE NOT gone
  UNION ALL SELECT doc_id, n, 1, 'mark' || n, true FROM numbered WHERE followed),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n, place) AS k FROM edited)"""


def edits(spark, sf_dir):
    """doc_id, text, edited."""
    tree = D.source_tree(spark, sf_dir).select("doc_id", "text").withColumn("l", X.split_lines("text"))
    doc = F.col("doc_id")

    def one(line, k):
        n = k + 1
        own = F.when((n + doc) % 7 == 0, F.concat(line, F.lit(" mark"), n.cast("string"))).otherwise(line)
        more = F.concat(F.lit("mark"), n.cast("string"))
        return F.array_compact(F.array(F.when((n + doc) % 5 != 0, own), F.when((n * doc) % 11 == 3, more)))

    return tree.select("doc_id", F.array_join("l", "\n").alias("text"), F.array_join(F.flatten(F.transform("l", one)), "\n").alias("edited"))


@query("changed_lines", f"""WITH {_EDITED_SQL}
SELECT doc_id, min(k) AS first, max(k) AS last FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM placed WHERE marked)
GROUP BY doc_id, run""")
def changed_lines(spark, sf_dir):
    """Ranges of lines that were added or changed between each document and its edited form, from the two texts alone."""
    ranges = changed_ranges_udf("text", "edited")
    return edits(spark, sf_dir).select("doc_id", F.inline(ranges)).select("doc_id", F.col("first").cast("long"), F.col("last").cast("long"))


# Lines from 1; `upto` is the number of characters of a document's first n lines, with their ends.
@query("symbol_windows", f"""WITH {D.TREE_SQL},
lined AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')[-1] AS word FROM tree),
named AS (SELECT *, list_position(list_transform(l, lambda x: contains(x, word)), true) AS found FROM lined WHERE length(text) > 1000),
sums AS (SELECT doc_id, n, sum(size) OVER (PARTITION BY doc_id ORDER BY n) AS upto FROM
  (SELECT doc_id, 0 AS n, 0 AS size FROM named UNION ALL SELECT doc_id, unnest(range(1, len(l) + 1)), unnest(list_transform(l, lambda x: length(x) + 1)) FROM named)),
radius AS (SELECT doc_id, max(found - 1 - lo.n) AS r FROM named JOIN sums lo USING (doc_id) JOIN sums hi USING (doc_id)
  WHERE lo.n < found AND hi.n = found + (found - 1 - lo.n) AND hi.upto - lo.upto <= 1000 GROUP BY doc_id),
core AS (SELECT doc_id, found - coalesce(r, 0) AS top, found + coalesce(r, 0) AS bottom FROM named LEFT JOIN radius USING (doc_id) WHERE found > 0),
upwards AS (SELECT doc_id, min(lo.n) + 1 AS top FROM core JOIN sums hi USING (doc_id) JOIN sums lo USING (doc_id)
  WHERE hi.n = bottom AND lo.n < core.top - 1 AND hi.upto - lo.upto <= 1000 GROUP BY doc_id),
downwards AS (SELECT doc_id, max(hi.n) AS bottom FROM core JOIN sums hi USING (doc_id) JOIN sums lo USING (doc_id)
  WHERE lo.n = core.top - 1 AND hi.n > core.bottom AND hi.upto - lo.upto <= 1000 GROUP BY doc_id),
spans AS (SELECT doc_id, coalesce(u.top, c.top) AS top, CASE WHEN u.top IS NULL THEN coalesce(d.bottom, c.bottom) ELSE c.bottom END AS bottom
  FROM core c LEFT JOIN upwards u USING (doc_id) LEFT JOIN downwards d USING (doc_id))
SELECT doc_id, length(text) > 1000 AS cut, md5(CASE WHEN length(text) <= 1000 THEN text WHEN top IS NULL THEN left(text, 1000) ELSE array_to_string(l[top:bottom], chr(10)) END) AS digest
FROM lined LEFT JOIN spans USING (doc_id)""")
def symbol_windows(spark, sf_dir):
    """Window of at most 1000 characters around the first line with the last word of every document; without a word its head."""
    tree = D.source_tree(spark, sf_dir).select("doc_id", "text")
    word = F.try_element_at(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.lit(-1))
    rows = tree.withColumn("w", V.symbol_window_udf(1000)(F.col("text"), F.array(word)))
    return rows.select("doc_id", F.col("w.cut").alias("cut"), F.md5("w.text").alias("digest"))


@query("dropped_drafts", f"""WITH {_PATCH_SQL}
SELECT doc_id, true AS removed, md5('Report' || chr(10) || '{V.DRAFT_NOTE}' || chr(10) || 'done' || chr(10) || chr(10) || '## Patch' || chr(10) || l[1]) AS digest FROM patched""")
def dropped_drafts(spark, sf_dir):
    """Reports with a fenced draft diff in front of the kept patch section."""
    rows = patches(spark, sf_dir)
    keep = "\n\n## Patch\n"
    report = F.concat(F.lit("Report\n```diff\n"), "patch", F.lit("```\ndone"), F.lit(keep), F.element_at(X.split_lines("text"), 1))
    cleaned = V.drop_drafts_udf(report, F.lit(keep))
    return rows.select("doc_id", cleaned.alias("c")).select("doc_id", F.col("c.removed").alias("removed"), F.md5("c.text").alias("digest"))


@query("answer_sections", f"""WITH {_PATCH_SQL}
SELECT doc_id, md5(l[1] || chr(10) || 'assert') AS section, md5(regexp_replace('--- a/' || path || chr(10) || '+++ b/' || path || chr(10) || '@@ -1,2 +1,3 @@' || chr(10) || ' ' || l[1]
  || chr(10) || '-' || old || chr(10) || '+' || l2 || ' fixedValue' || chr(10) || '+added MAX_SPEED', '\\s+$', '')) AS diff FROM patched""")
def answer_sections(spark, sf_dir):
    """Unit-test section and first diff of an answer."""
    rows = patches(spark, sf_dir)
    first = F.element_at(X.split_lines("text"), 1)
    answer = F.concat(F.lit("## Cause\nx\n## Unit test\n"), first, F.lit("\nassert\n## Patch\n```diff\n"), "patch", F.lit("\n```\n"))
    rows = rows.withColumn("answer", answer)
    return rows.select("doc_id", F.md5(X.section("answer", "unit test", "unit-test")).alias("section"), F.md5(X.first_diff("answer")).alias("diff"))


@query("patch_tries", f"""WITH {_PATCH_SQL}
SELECT doc_id, doc_id % 4 <> 0 AS answered, CASE
    WHEN doc_id % 4 = 0 THEN 'Generated patch still fails validation after retries: no answer came. Verify on a real build.'
    WHEN doc_id % 3 = 0 OR len(l) < 2 THEN 'Generated patch still fails validation after retries: the diff did not apply (a hunk''s context did not match the file). Verify on a real build.'
    ELSE 'Syntax NOT verified: no parser for ''' || {D.sql_suffix('path')} || '''.' END AS note FROM patched""")
def patch_tries(spark, sf_dir):
    """Patch rounds over whole files: one target in four never gets an answer, one patch in three never fits."""
    rows = written(patches(spark, sf_dir).withColumn("symbols", F.array().cast("array<string>")), "patches-wanted")
    answers = rows.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("bug_id"), F.col("patch").alias("answer"))

    def recorded(wanted):
        return wanted.select("bug_id").join(answers, "bug_id")

    found = L.patch_loop(rows.select(F.col("doc_id").alias("bug_id"), "path", "text", "symbols"), recorded)
    return found.select(F.col("bug_id").alias("doc_id"), F.col("patch").isNotNull().alias("answered"), "note")
