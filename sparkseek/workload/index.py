"""Snapshot, refresh and store queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import indexing
from ..sources import changes as C
from ..sources import stores as S
from ..workspace import new_folder, written
from . import data as D
from .chunks import sql_windows
from .registry import query
from .retrieval import _CONTENT, SETTINGS, search_over_tree, sql_indexed

# Between the two states toxic files are removed, good ones get a line, unlabelled ones with an even number are new.
_STATES_SQL = f"""{D.TREE_SQL},
state AS (SELECT t.*, l.doc_id IS NOT NULL OR doc_id % 2 = 1 AS before, coalesce(toxic, 0) = 0 AS after,
    CASE WHEN quality = 1 THEN text || chr(10) || 'edited' ELSE text END AS new_text FROM tree t LEFT JOIN labels l USING (doc_id))"""


def states(spark, sf_dir):
    """(files before, files after)."""
    tree = D.source_tree(spark, sf_dir)
    labels = D.table(spark, sf_dir, "labels").withColumn("labelled", F.lit(True))
    both = tree.join(labels, "doc_id", "left")
    before = both.where(F.col("labelled") | (F.col("doc_id") % 2 == 1)).select("path", "store", "text", "size_bytes")
    edited = F.when(F.col("quality") == 1, F.concat("text", F.lit("\nedited"))).otherwise(F.col("text"))
    after = both.where(F.coalesce("toxic", F.lit(0)) == 0).select("path", "store", edited.alias("text"))
    return before, after.withColumn("size_bytes", F.octet_length("text").cast("bigint"))


@query("snapshot_changes", f"""WITH {_STATES_SQL}
SELECT path, CASE WHEN NOT before THEN 'A' WHEN NOT after THEN 'D' ELSE 'M' END AS status FROM state
WHERE (before OR after) AND NOT (before AND after AND new_text = text)""")
def snapshot_changes(spark, sf_dir):
    """Changed paths between two snapshots of the tree."""
    before, after = states(spark, sf_dir)
    return C.snapshot_changes(C.snapshot(before), C.snapshot(after))


@query("refreshed_chunks", f"""WITH {_STATES_SQL},
present AS (SELECT path, new_text AS text FROM state WHERE after), {sql_windows('present', 'path')}
SELECT path || '::' || idx AS chunk_id, md5({_CONTENT}) AS digest FROM windows""")
def refreshed_chunks(spark, sf_dir):
    """Chunks after an incremental refresh: they must be those of a full build of the new state."""
    before, after = states(spark, sf_dir)
    after = written(after, "after")
    chunks = written(indexing.chunk_rows(before), "chunks-before")
    changes = written(C.snapshot_changes(C.snapshot(before), C.snapshot(after)), "changes")
    changed = after.join(changes.where("status <> 'D'").select("path"), "path", "left_semi")
    fresh = indexing.refreshed_chunks(chunks, changed, changes)
    return fresh.select("chunk_id", F.md5("content").alias("digest"))


@query("store_contents", f"""WITH {sql_indexed()}
SELECT store, {D.sql_layer('path')} AS layer, count(*) AS chunks, count(DISTINCT path) AS files, CAST(sum(content_len) AS BIGINT) AS chars FROM chunk GROUP BY ALL""")
def store_contents(spark, sf_dir):
    """What the built stores hold per layer."""
    chunks = search_over_tree(spark, sf_dir).store.table("chunks")
    per_file = chunks.groupBy("store", "layer", "path").agg(F.count("*").alias("c"), F.sum("content_len").alias("n"))
    return per_file.groupBy("store", "layer").agg(
        F.sum("c").alias("chunks"), F.count("*").alias("files"), F.sum("n").alias("chars")
    )


@query("name_status_changes", f"""WITH {D.TREE_SQL}
SELECT path, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'M' WHEN 2 THEN 'D' ELSE 'A' END AS status FROM tree
UNION ALL SELECT 'old/' || path, 'D' FROM tree WHERE doc_id % 4 = 3""")
def name_status_changes(spark, sf_dir):
    """Version-control name-status lines, renames included, as changes."""
    kind = F.col("doc_id") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("A\t"), "path")).when(kind == 1, F.concat(F.lit("M\t"), "path"))
        .when(kind == 2, F.concat(F.lit("D\t"), "path")).otherwise(F.concat(F.lit("R087\told/"), "path", F.lit("\t"), "path"))
    )
    return C.parse_name_status(D.source_tree(spark, sf_dir).select(line.alias("value")))


@query("tenant_views", f"""WITH {sql_indexed()}, owned AS (SELECT c.store, c.path, doc_id FROM chunk c JOIN tree t ON t.store = c.store AND t.path = c.path)
SELECT tenant, store, count(*) AS chunks, count(DISTINCT path) AS files
FROM owned JOIN (VALUES ('oem-a', 0), ('oem-b', 1)) v(tenant, side) ON store = 'base' OR doc_id % 2 = side GROUP BY ALL""")
def tenant_views(spark, sf_dir):
    """What two customers see of one shared layer and a layer of their own each."""
    provider = S.StoreProvider(spark, new_folder(spark, "tenants"), SETTINGS.retrieval.embed_model)
    tree = D.source_tree(spark, sf_dir).select("doc_id", "path", "store", "size_bytes", "text")
    tenants = [S.Tenant("oem-a"), S.Tenant("oem-b")]
    indexing.build_store(tree.where("store = 'base'").drop("store", "doc_id"), provider.base_folder(tenants[0].version), "base", SETTINGS)
    views = []
    for side, tenant in enumerate(tenants):
        own = tree.where(F.col("store") == "customer").where(F.col("doc_id") % 2 == side).drop("store", "doc_id")
        indexing.build_store(own, provider.customer_folder(tenant), "customer", SETTINGS)
        chunks = provider.open(tenant).table("chunks").groupBy("store", "path").agg(F.count("*").alias("n"))
        views.append(chunks.groupBy("store").agg(F.sum("n").alias("chunks"), F.count("*").alias("files")).withColumn("tenant", F.lit(tenant.customer)))
    return views[0].unionByName(views[1])
