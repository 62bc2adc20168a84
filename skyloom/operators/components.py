"""Connected components of a graph that is small next to the data: what contradicts itself in a batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import materialise

#: Edges up to which one task may join the trees of all others; about 100 bytes each.
ONE_TASK = 2_000_000


def _trees(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each node of a partition's edges with the smallest node that these edges connect it to."""
    parent: dict[str, str] = {}

    def root(node: str) -> str:
        while parent.setdefault(node, node) != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    for frame in frames:
        for a, b in zip(frame["a"], frame["b"]):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    nodes = list(parent)
    for at in range(0, len(nodes), 100_000):
        some = nodes[at:at + 100_000]
        yield pd.DataFrame({"a": some, "b": [root(n) for n in some]})


def components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """``node, component`` (its smallest connected node) for the nodes of ``edges`` (``a, b``: text).

    Every task first reduces its edges to trees, one edge a node. While these are at most ``one_task`` edges, one task joins
    them all; beyond that, neighbours' smallest nodes are passed on in rounds until nothing changes. Either way the trees are
    written once before, so what made the edges is not computed again.
    """
    trees = materialise(edges.select("a", "b").mapInPandas(_trees, "a string, b string").filter("a <> b"))
    alone = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    if trees.limit(one_task + 1).count() <= one_task:
        found = trees.coalesce(1).mapInPandas(_trees, "a string, b string")
    else:
        found = _rounds(trees)
    named = found.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return alone.join(named, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _rounds(edges: DataFrame) -> DataFrame:
    """``a, b`` with each node's smallest connected node as ``b``; larger and smaller neighbours are linked to the smallest in turn."""
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = materialise(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        edges = materialise(large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        ).select("e.a", "e.b").filter("a <> b").distinct())
        roots = edges.select(F.col("a").alias("b"))
        if edges.groupBy("a").count().filter("count > 1").isEmpty() and edges.join(roots, "b", "left_semi").isEmpty():
            return edges.union(edges.select("b", "b")).toDF("a", "b").distinct()
