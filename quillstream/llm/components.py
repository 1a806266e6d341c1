"""Connected components of a distributed edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014): each round hangs neighbours on the
smallest node seen, until the edges are stars.  Nothing but row counts comes to
the driver, and each round's edges are written by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _rehang(pairs: DataFrame) -> DataFrame:
    """(node, nb) to (nb, least), least: the smallest of the node and its neighbours.

    The least is a plain aggregate joined back, so a node with very many
    neighbours is split like any skewed join side.
    """
    least = pairs.groupBy("node").agg(F.least(F.min("nb"), F.first("node")).alias("least"))
    return pairs.join(least, "node").select("node", "nb", "least")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs to (node, component): the smallest node reachable from each.

    Only nodes that have an edge to another node are returned.  Nulls and loops
    are ignored, repeated edges count once, an empty table gives an empty table.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    before = None
    for _ in range(max_rounds):
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("nb")).union(edges.select(F.col("v").alias("node"), F.col("u").alias("nb")))
        large = _rehang(both).where("nb > node").select(F.col("nb").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
        down = _rehang(large.select(F.col("u").alias("node"), F.col("v").alias("nb")))
        small = down.select(F.col("nb").alias("u"), F.col("least").alias("v")).union(down.select(F.col("node").alias("u"), F.col("least").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
