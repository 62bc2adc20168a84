"""Connected components of an undirected graph of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import staged


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest reachable node) of every node in ``edges`` (``a, b``: long).

    Each round links a node's larger neighbours to its smallest one, then its smaller neighbours likewise; the number of
    rounds grows with the logarithm of the longest path. Rounds are stored, so no lineage builds up, and
    grouping takes a minimum per node, which is combined before the shuffle; neighbour lists are never collected.
    """
    edges = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "edges")
        # Now every b is smaller than its a: link the smaller neighbours of a, and a, to the smallest.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct()
        small = staged(small, "edges")
        # Done when each node has one link and it leads to a root.
        done = small.groupBy("a").count().filter("count > 1").isEmpty() and small.join(
            small.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
        edges = small
        if done:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
