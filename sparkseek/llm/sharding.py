"""Balanced label propagation: shards of equal size that keep linked documents together.

Documents start dealt out evenly. In each round every linked document looks up, through its groups, how many of its
neighbours lie in each shard, and wants the shard with most of them (in every other round: of those that have room). The
documents that want from one shard into another are numbered in a fixed random order. As many move as want back, and
beyond that as many as the quota of rows allows. Documents without links have no say: they fill, at the end, what the
others left free. So the quota is met exactly, and a group larger than a shard fills several. Only (group, shard) counts,
added up map side first, and the numbers of pairs of shards meet in one place.

Links come as membership in groups, so a group of any size is one row per member and never a list of pairs.

Defined results: `rows` law: shard sizes are at most one row apart; null groups link nothing; repeated rows count each;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_groups, written


def numbered(df: DataFrame, by: list[str], row: str, added: str, per_bucket: int = 50_000) -> DataFrame:
    """Numbers from 0 without gaps within each `by`, in the order of the hash of a unique row id.

    Rows are numbered in buckets of the hash, and a bucket's rows go on from where the last bucket ended, so no task
    holds all rows of one `by`.
    """
    buckets = max(1, df.count() // per_bucket)
    df = df.withColumn("order_", F.xxhash64(row)).withColumn("bucket_", F.pmod(F.shiftrightunsigned("order_", 8), F.lit(buckets)))
    within = df.withColumn(added, F.row_number().over(Window.partitionBy(*by, "bucket_").orderBy("order_", row)) - 1)
    if buckets > 1:
        counts = df.groupBy(*by, "bucket_").count()
        before = Window.partitionBy(*by).orderBy("bucket_").rowsBetween(Window.unboundedPreceding, -1)
        offset = counts.select(*by, "bucket_", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset_"))
        within = within.join(offset, [*by, "bucket_"]).withColumn(added, F.col(added) + F.col("offset_")).drop("offset_")
    return within.drop("order_", "bucket_").withColumn(added, F.col(added).cast("long"))


def _filled(slot: Column, room: list[int]) -> Column:
    """The shard of a slot when shards are filled one after the other."""
    shard = F.lit(0)
    for k in range(1, len(room)):
        shard = shard + (slot >= sum(room[:k])).cast("int")
    return shard


def _allowed(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """Of the documents that want from one shard into another, how many may: those that swap, and more while there is room."""
    left = list(room)
    allowed = {}
    for (i, j), n in sorted(wanted.items()):
        swaps = min(n, wanted.get((j, i), 0))
        more = min(n - swaps, left[j])
        left[j] -= more
        allowed[i, j] = swaps + more
    return allowed


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy("shard").count().collect()}
    return [found.get(k, 0) for k in range(shards)]


def balanced_shards(nodes: DataFrame, links: DataFrame, shards: int = 40, rounds: int = 6) -> DataFrame:
    """(row, shard, slot) of nodes (row, unique) under links (row, group); slots are gapless within a shard."""
    nodes = written(nodes.select("row"), "nodes")
    total = nodes.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    sizes = links.filter("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("size")).filter("size > 1")
    sizes = written(sizes, "groups")
    member_rows = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    members = written(join_groups(links, sizes, "group", "size", member_rows).select("row", "group", "size"), "members")
    first = numbered(nodes, [], "row", "slot").select("row", F.pmod("slot", F.lit(shards)).cast("int").alias("shard"))
    state = written(first.join(members.select("row").distinct(), "row", "left_semi"), "shards-of-linked")

    idle = 0
    for number in range(rounds):
        room = [q - n for q, n in zip(quota, _by_shard(state, shards), strict=True)]
        placed = members.join(state, "row")
        per_shard = [F.sum(F.when(F.col("shard") == k, 1).otherwise(0)).alias(f"n{k}") for k in range(shards)]
        counts = placed.groupBy("group").agg(*per_shard)
        near = join_groups(placed, sizes.select("group", F.col("size").alias("all")).join(counts, "group"), "group", "all", member_rows)
        # Ties go to the same shard for a whole group.
        turn = F.min(F.pmod(F.xxhash64("group"), F.lit(shards))).alias("turn")
        near = near.groupBy("row", "shard").agg(turn, *[F.sum(f"n{k}").alias(f"n{k}") for k in range(shards)])
        choices = [
            F.when(
                (F.lit(number % 2 == 0 or room[k] > 0) | (F.col("shard") == k)) & (F.col(f"n{k}") > 0),
                F.struct(F.col(f"n{k}").alias("near"), F.pmod(F.col("turn") + k, F.lit(shards)).alias("turn"), F.lit(k).alias("to")),
            )
            for k in range(shards)
        ]
        wants = near.select("row", "shard", F.array_max(F.array_compact(F.array(*choices)))["to"].alias("to"))
        wants = written(wants.filter(F.col("to") != F.col("shard")), "moves")
        allowed = _allowed({(r["shard"], r["to"]): r["count"] for r in wants.groupBy("shard", "to").count().collect()}, room)
        idle = 0 if any(allowed.values()) else idle + 1
        if idle == 2:
            break
        if idle:
            continue
        most = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for (i, j), n in allowed.items() for x in (i * shards + j, n)]), F.col("shard") * shards + F.col("to")), F.lit(0))
        moved = numbered(wants, ["shard", "to"], "row", "place").filter(F.col("place") < most).select("row", "to")
        state = written(state.join(moved, "row", "left").select("row", F.coalesce("to", "shard").alias("shard")), "shards-of-linked")

    room = [q - n for q, n in zip(quota, _by_shard(state, shards), strict=True)]
    single = numbered(nodes.join(state, "row", "left_anti"), [], "row", "slot")
    placed = state.unionByName(single.select("row", _filled(F.col("slot"), room).cast("int").alias("shard")))
    return numbered(written(placed, "sharded"), ["shard"], "row", "slot")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Documents (doc_id, text) in shards; equal texts are linked. doc_id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = written(
        docs.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group"),
        ),
        "documents",
    )
    return nodes.drop("group").join(balanced_shards(nodes, nodes.select("row", "group"), shards), "row").drop("row")


def write_shards(docs: DataFrame, shard: str, path: str) -> None:
    """One folder per shard."""
    docs.repartition(shard).write.partitionBy(shard).parquet(path)
