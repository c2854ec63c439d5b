"""Connected components by alternating large-star and small-star steps.

Every step is an aggregation and a join over the edges; stars shrink towards the smallest node of each component,
so edges never outnumber nodes for long and a hub's neighbours never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """large: neighbours above a node go to its least neighbour; else neighbours below it, and the node itself, do."""
    ways = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = ways.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    met = ways.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, node: str = "node", root: str = "root") -> DataFrame:
    """(node, root): every node of the edges (a, b) with the smallest node it is connected to.

    NULL ends and loops are left out; an empty table gives an empty one.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = staged(edges, "edges"), None
    while True:
        count = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if count == before or count[0] == 0:
            break
        before = count
        edges = staged(_stars(_stars(edges, large=True), large=False), "edges")
    return edges.select(F.col("a").alias(node), F.col("b").alias(root)).unionByName(edges.select(F.col("b").alias(node), F.col("b").alias(root))).distinct()
