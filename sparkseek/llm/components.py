"""Connected components by repeated hooking and contraction, as joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node that can be reached.

    In each round a node takes the smallest neighbour below it as parent, then its parent's parent as label, twice; edges
    between labels go on to the next round. Labels of nodes without edges are final.
    """
    ordered = lambda frame: frame.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    edges = written(ordered(edges), "edges")
    labels = written(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while edges.take(1):
        parent = written(edges.groupBy("b").agg(F.min("a").alias("p")).withColumnRenamed("b", "node"), "parents")
        above = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = parent.join(above, "p", "left").select("node", F.coalesce("pp", "p").alias("p"))
        above = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
        parent = written(parent.join(above, "p", "left").select("node", F.coalesce("pp", "p").alias("p")), "parents")
        labels = written(_relabelled(labels, "root", parent), "labels")
        edges = written(ordered(_relabelled(_relabelled(edges, "a", parent), "b", parent)), "edges")
    return labels


def _relabelled(frame: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    found = frame.join(parent.withColumnRenamed("node", column), column, "left").withColumn(column, F.coalesce("p", column)).drop("p")
    return found.select(*frame.columns)
