"""Chunking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import Settings
from ..operators import chunking
from . import data as D
from .registry import query

_R = Settings().retrieval
_SIZE, _STEP = _R.chunk_size, _R.chunk_size - _R.chunk_overlap


def sql_windows(relation: str, columns: str) -> str:
    """CTE `windows` (columns, idx, content): overlapping windows of each text."""
    return f"""
windows AS (SELECT {columns}, CAST(k AS INT) AS idx, substr(text, k * {_STEP} + 1, {_SIZE}) AS content
  FROM {relation}, LATERAL (SELECT unnest(range(CASE WHEN length(text) <= {_SIZE} THEN 1
    ELSE CAST(ceil((length(text) - {_SIZE}) / {_STEP}.0) AS BIGINT) + 1 END)) AS k) WHERE length(text) > 0)"""


STRIP = r"regexp_replace(content, '^\s+|\s+$', '', 'g')"


@query("window_chunks", f"WITH {sql_windows('documents', 'doc_id')} SELECT doc_id, idx, length(content) AS chars, md5(content) AS digest FROM windows")
def window_chunks(spark, sf_dir):
    """Fixed windows with overlap, all built-in expressions."""
    windows = chunking.window_chunks(D.documents(spark, sf_dir, "doc_id", "text"), _R.chunk_size, _R.chunk_overlap)
    return windows.select("doc_id", "idx", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query("file_chunks", f"""WITH {D.TREE_SQL}, {sql_windows('tree', 'path, text')}
SELECT path || '::' || idx AS chunk_id, {D.sql_suffix('path')} AS ext, {D.sql_layer('path')} AS layer,
  length({STRIP}) AS chars, md5({STRIP}) AS digest
FROM windows WHERE regexp_matches(text, '\\S')""")
def file_chunks(spark, sf_dir):
    """Chunk records of every file of the tree: catalog, structural or window cut, whichever applies."""
    tree = D.source_tree(spark, sf_dir).select("path", "text")
    chunks = chunking.chunk_files(tree, _R.chunk_size, _R.chunk_overlap)
    return chunks.select("chunk_id", "ext", "layer", F.length("content").alias("chars"), F.md5("content").alias("digest"))


@query("unit_chunks", f"""
WITH paragraph AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
unit AS (SELECT doc_id, n, CASE WHEN n = 1 THEN line ELSE 'class Unit' || n || ' ' || line END AS body FROM paragraph),
lens AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY n) AS code FROM unit GROUP BY doc_id)
SELECT doc_id, length(code) AS code_chars, len(regexp_extract_all(code, '(?m)^class Unit')) AS units FROM lens""")
def unit_chunks(spark, sf_dir):
    """Structural cut: every line of a document is turned into a unit; the chunks must cover the whole text.

    Covered characters are counted from the chunk offsets, overlaps once, so a lost or invented piece shows.
    """
    lines = F.split("text", "\n")
    code = F.array_join(
        F.transform(lines, lambda l, i: F.when(i == 0, l).otherwise(F.concat(F.lit("class Unit"), (i + 1).cast("string"), F.lit(" "), l))), "\n"
    )
    docs = D.documents(spark, sf_dir, "doc_id", "text").select("doc_id", code.alias("code"))
    ranges = docs.withColumn("r", chunking._unit_range_udf(_R.chunk_size, _R.chunk_overlap)(F.col("code")))
    gaps = F.aggregate(
        "r",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("covered")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["hi"]).alias("end"),
            (acc["covered"] + F.greatest(x["hi"] - F.greatest(acc["end"], x["lo"]), F.lit(0))).alias("covered"),
        ),
    )
    return ranges.select(
        "doc_id",
        gaps["covered"].alias("code_chars"),
        F.size(F.regexp_extract_all("code", F.lit("(?m)^class Unit"), F.lit(0))).alias("units"),
    )


@query("signal_catalog", """
SELECT p_partkey, 0 AS idx, 'Vehicle.' || replace(p_brand, '#', '') || '.' || p_type || '.P' || p_partkey AS signal,
  'datatype: float' || chr(10) || 'type: sensor' || chr(10) || 'unit: ' || p_type || chr(10) || 'max: ' || p_size AS attrs
FROM part""")
def signal_catalog(spark, sf_dir):
    """Signals of nested catalogs: each part is written as a small catalog file and read back leaf by leaf."""
    parts = D.table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size")
    brand = F.regexp_replace("p_brand", "#", "")
    leaf = F.format_string('{"datatype": "float", "type": "sensor", "unit": "%s", "max": %d}', "p_type", "p_size")
    tree = F.format_string(
        '{"Vehicle": {"type": "branch", "children": {"%s": {"type": "branch", "children": {"%s": {"P%d": %s}}}}}}',
        brand, F.col("p_type"), F.col("p_partkey"), leaf,
    )
    files = parts.select("p_partkey", F.concat(F.lit("vendor/oem/vss/"), F.col("p_partkey").cast("string"), F.lit(".json")).alias("path"), tree.alias("text"))
    signals = chunking.catalog_signals(files)
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return signals.select("p_partkey", "idx", "signal", attrs.alias("attrs"))


@query("flat_signal_catalog", """
SELECT s_nationkey AS nation, 'Vehicle.Supplier.S' || s_suppkey AS signal, 'sensor' AS type, CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) AS max
FROM supplier""")
def flat_signal_catalog(spark, sf_dir):
    """Signals of flat catalogs: one YAML file per supplier with a branch entry that is no signal."""
    suppliers = D.table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    text = F.format_string(
        "Vehicle.Supplier:\n  type: branch\nVehicle.Supplier.S%d:\n  type: sensor\n  max: %d\n",
        F.col("s_suppkey"), F.floor("s_acctbal"),
    )
    files = suppliers.select("s_nationkey", F.concat(F.lit("vss/"), F.col("s_suppkey").cast("string"), F.lit(".vspec")).alias("path"), text.alias("text"))
    return chunking.catalog_signals(files).select(
        F.col("s_nationkey").alias("nation"), "signal", F.col("attrs")["type"].alias("type"), F.col("attrs")["max"].alias("max")
    )
