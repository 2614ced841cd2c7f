"""Inputs of the queries, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..sources.tables import read_table

# Folder of each document source in the virtual tree.
TREE_FOLDERS = (
    "packages/services/Car/service", "hardware/interfaces/automotive/vehicle/aidl",
    "hardware/interfaces/automotive/vehicle/2.0", "packages/apps/Car/Settings", "frameworks/base/core",
    "frameworks/native/libs/binder", "system/sepolicy/private", "vendor/oem/vss/mapping", "vendor/oem/hmi/cluster",
    "device/oem/common", "external/protobuf/src", "packages/services/Car/tests", "prebuilts/sdk/tools",
    "system/core/powerpolicy", "vendor/oem/signal", "out/soong/gen", "hardware/interfaces/automotive/vhal/impl",
    "frameworks/av/media", "vendor/oem/docs/samples", "system/core/libutils",
)
# File suffix of each language.
TREE_SUFFIXES = {"en": ".java", "fr": ".cpp", "de": ".aidl", "es": ".yaml"}


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/documents.parquet", list(columns) or None, spread=True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", list(columns) or None)


def bug_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: the benchmark passages as search queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def with_path(docs: DataFrame) -> DataFrame:
    """Adds the path and the store of a document in the virtual tree; needs doc_id, text, lang, source."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    folder = F.element_at(F.array(*[F.lit(f) for f in TREE_FOLDERS]), F.pmod(number, F.lit(len(TREE_FOLDERS))) + 1)
    suffix = F.lit(".txt")
    for lang, ending in TREE_SUFFIXES.items():
        suffix = F.when(F.col("lang") == lang, F.lit(ending)).otherwise(suffix)
    # Filters on the path compute it many times, so the whole text is looked at only if no word ends in its head.
    early = F.regexp_extract(F.lower(F.substring("text", 1, 256)), "([a-z_][a-z0-9_]+)[^a-z0-9_]", 1)
    word = F.regexp_extract(F.lower("text"), "[a-z_][a-z0-9_]+", 0)
    word = F.when(early != "", early).when(word == "", "unit").otherwise(word)
    path = F.concat(folder, F.lit("/"), "source", F.lit("/"), word, F.lit("-"), F.col("doc_id").cast("string"), suffix)
    customer = folder.startswith("vendor/") | folder.startswith("device/")
    return docs.withColumn("path", path).withColumn("store", F.when(customer, "customer").otherwise("base"))


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, store, lang, source, text, size_bytes: the documents as files."""
    docs = with_path(documents(spark, sf_dir, "doc_id", "text", "lang", "source"))
    return docs.withColumn("size_bytes", F.octet_length("text").cast("bigint"))


# -- SQL -------------------------------------------------------------------------------------------------------------


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_text(v) for v in values) + "]"


def sql_contains_any(column: str, parts) -> str:
    return "(" + (" OR ".join(f"contains({column}, {sql_text(p)})" for p in parts) or "false") + ")"


def sql_ends_with_any(column: str, endings) -> str:
    return "(" + (" OR ".join(f"ends_with({column}, {sql_text(e)})" for e in endings) or "false") + ")"


def sql_rooted(path: str) -> str:
    return f"(CASE WHEN starts_with({path}, '/') THEN lower({path}) ELSE '/' || lower({path}) END)"


def sql_suffix(path: str) -> str:
    return f"lower(regexp_extract({path}, '[^/.][^/]*(\\.[^./]+)$', 1))"


def sql_stem(path: str) -> str:
    return f"regexp_replace(regexp_extract({path}, '[^/]*$'), '(.)\\.[^.]+$', '\\1')"


def sql_legacy(path: str) -> str:
    p = sql_rooted(path)
    return f"({sql_contains_any(p, fv.LEGACY_MARKERS)} OR ends_with({p}, '.hal'))"


def sql_layer(path: str) -> str:
    p = sql_rooted(path)
    cases = " ".join(
        f"WHEN {sql_contains_any(p, parts)} OR {sql_ends_with_any(p, ends)} THEN '{layer}'" for layer, parts, ends in fv.LAYER_RULES
    )
    return f"(CASE {cases} ELSE '{fv.DEFAULT_LAYER}' END)"


def sql_should_index(path: str, size: str, mode: str) -> str:
    p = sql_rooted(path)
    segments = fv.BASE_EXCLUDED_SEGMENTS if mode == "base" else fv.CUSTOMER_EXCLUDED_SEGMENTS
    test = (
        f"list_contains({sql_list(fv.CODE_SUFFIXES)}, {sql_suffix(path)}) AND NOT {sql_legacy(path)} "
        f"AND {size} >= 0 AND NOT list_has_any(string_split({p}, '/'), {sql_list(segments)})"
    )
    if mode == "base":
        test += (
            f" AND NOT {sql_contains_any(p, fv.BASE_EXCLUDED_PARTS)} AND NOT {sql_ends_with_any(p, fv.BASE_EXCLUDED_ENDINGS)}"
        )
    return f"({test})"


def sql_under_roots(path: str, roots) -> str:
    if "." in roots:
        return "true"
    return "(" + " OR ".join(f"({path} = {sql_text(r)} OR starts_with({path}, {sql_text(r + '/')}))" for r in roots) + ")"


_SUFFIX_CASES = " ".join(f"WHEN '{lang}' THEN '{ending}'" for lang, ending in TREE_SUFFIXES.items())
TREE_SQL = f"""
tree_folder AS (
  SELECT doc_id, text, lang, source,
    {sql_list(TREE_FOLDERS)}[CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % {len(TREE_FOLDERS)} + 1] AS folder,
    regexp_extract(lower(text), '[a-z_][a-z0-9_]+') AS word
  FROM documents),
tree AS MATERIALIZED (
  SELECT doc_id, text, lang, source, strlen(text) AS size_bytes,
    folder || '/' || source || '/' || (CASE WHEN word = '' THEN 'unit' ELSE word END) || '-' || CAST(doc_id AS VARCHAR)
      || (CASE lang {_SUFFIX_CASES} ELSE '.txt' END) AS path,
    CASE WHEN starts_with(folder, 'vendor/') OR starts_with(folder, 'device/') THEN 'customer' ELSE 'base' END AS store
  FROM tree_folder)"""
