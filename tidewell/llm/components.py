"""Connected components of an edge table, by alternating large and small stars.

Each round replaces a node's links by links to the smallest node it sees, so trees flatten towards stars round their smallest
node in logarithmically many rounds. Hot nodes are pre-aggregated before the shuffle, and the joins can be split by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut

#: Edges of 16 to 100 bytes that one task may take.
EDGES_PER_TASK = 200_000


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v): for the large star both directions, else from the larger to the smaller node."""
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        both = edges.join(low.withColumn("m", F.least("u", "m")), "u")
        return both.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = edges.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.unionByName(low.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``u`` and ``v``); the component is its smallest node.

    Nulls and loops are left out; repeated and two-way edges count once; no edges, no rows.
    """
    edges = edges.select("u", "v").filter("u != v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    # a table of few edges goes on in few partitions
    few = lambda e, n: e.coalesce(max(1, n // EDGES_PER_TASK))
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = mark(edges)
    while seen[0]:
        edges = few(edges, seen[0])
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        down = _star(both, True).filter("u != v")
        edges = cut(_star(down.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False).filter("u != v").distinct())
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
