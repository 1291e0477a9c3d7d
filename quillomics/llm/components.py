"""Connected components of a graph given as edges, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import stored


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) for every node of edges (a, b).

    In each round every node moves to its smallest neighbour and edges between nodes that met go away; the rounds grow
    with the logarithm of the longest path. Edges and places are written to the shared folder between rounds. A node's
    neighbours are combined before they are shuffled.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    at = stored(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")), "places")
    while edges.head(1):
        both = edges.union(edges.select("b", "a"))
        moves = stored(both.groupBy(F.col("a").alias("from")).agg(F.min("b").alias("to")).withColumn("to", F.least("from", "to")), "moves")
        at = stored(
            at.join(moves, at["root"] == moves["from"], "left").select("node", F.coalesce("to", "root").alias("root")), "places",
        )
        first = moves.select(F.col("from").alias("a"), F.col("to").alias("a2"))
        second = moves.select(F.col("from").alias("b"), F.col("to").alias("b2"))
        met = edges.join(first, "a").join(second, "b").filter("a2 <> b2")
        edges = stored(met.select(F.greatest("a2", "b2").alias("a"), F.least("a2", "b2").alias("b")).distinct(), "edges")
    return at
