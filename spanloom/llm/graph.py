"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(arcs: DataFrame, large: bool) -> DataFrame:
    """One round over arcs (u, v). Each node's least neighbour comes from an aggregate with map-side combining and is joined back, so that
    a hub's arcs can be split between tasks."""
    if large:
        both = arcs.unionByName(arcs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        down = arcs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the least node of its component.

    edges has two bigint columns a and b without nulls. Loops and repeated edges don't matter, but a node that has only loops isn't returned.
    """
    arcs = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        arcs = cut(_star(_star(arcs, True), False))
        now = arcs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    return arcs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(arcs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
