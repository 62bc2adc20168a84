"""Approximate nearest neighbours by inner product: a forest of random-projection trees and an exact ranking of leaves.

Trees split at the hyperplane midway between two sampled vectors, and are fitted on a bounded sample; every vector is
then put into its leaf of every tree. A query walks all trees through one priority queue, nearest side first, until
it has its number of leaves. Leaves are joined with queries in Spark, where leaves that hold many vectors or get many
queries are worked on in blocks; scores are exact inner products in double precision of the vectors as given.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import staged
from skyloom.llm.jaccard_join import _runs

#: Rows that the trees are fitted on, trees, sampled rows to a leaf, and leaves that a query visits.
SAMPLE, TREES, LEAF, VISITS = 16_384, 12, 48, 300
#: Vectors and queries that one unit of work takes of a leaf.
BLOCK = 4096


class Tree(NamedTuple):
    """Inner nodes: ``planes`` (with the offset last), and children; a child below 0 is leaf ``-1 - child``."""

    planes: np.ndarray
    children: np.ndarray
    leaves: int


def fit_tree(sample: np.ndarray, leaf: int, random: np.random.Generator) -> Tree:
    planes, children, leaves = [], [], 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf:
            for _ in range(5):
                a, b = sample[random.choice(rows, 2, replace=False)]
                normal = (a - b) / max(float(np.linalg.norm(a - b)), 1e-300)
                side = sample[rows] @ normal - (a + b) @ normal / 2 > 0
                if 0.05 < side.mean() < 0.95:
                    at = len(planes)
                    planes.append(np.append(normal, -(a + b) @ normal / 2))
                    children.append([0, 0])
                    children[at] = [grow(rows[~side]), grow(rows[side])]
                    return at
        leaves += 1
        return -leaves

    grow(np.arange(len(sample)))
    width = sample.shape[1] + 1
    return Tree(np.array(planes).reshape(-1, width), np.array(children, np.int64).reshape(-1, 2), leaves)


def leaves_of(tree: Tree, vectors: np.ndarray) -> np.ndarray:
    """The leaf of each vector."""
    at = np.zeros(len(vectors), np.int64) if len(tree.planes) else np.full(len(vectors), -1)
    while (inner := np.flatnonzero(at >= 0)).size:
        plane = tree.planes[at[inner]]
        right = np.einsum("ij,ij->i", vectors[inner], plane[:, :-1]) + plane[:, -1] > 0
        at[inner] = tree.children[at[inner], right.astype(np.int64)]
    return -1 - at


def search(forest: list[Tree], query: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """(tree, leaf) of the ``visits`` leaves that a shared queue over all trees gives first.

    A place is as near as the worst hyperplane on the way to it.
    """
    queue = [(-math.inf, t, 0 if len(tree.planes) else -1) for t, tree in enumerate(forest)]
    margins = [tree.planes[:, :-1] @ query + tree.planes[:, -1] for tree in forest]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < visits:
        far, t, at = heapq.heappop(queue)
        if at < 0:
            found.append((t, -1 - at))
            continue
        margin = margins[t][at]
        low, high = forest[t].children[at]
        heapq.heappush(queue, (max(far, -margin), t, int(high)))
        heapq.heappush(queue, (max(far, margin), t, int(low)))
    return found


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of rows with an id and a finite vector that is not zero.

    Vectors of another length than most have take no part. Of rows with one id, the smallest vector stands for it.
    """
    single = table.schema[vector_col].dataType.simpleString() == "array<float>"
    vectors = table.select(table[id_col].cast("long").alias("id"), table[vector_col].cast(
        "array<float>" if single else "array<double>").alias("vector")).filter(
        F.col("id").isNotNull() & F.forall("vector", lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False)) & ~F.isnan(x))
        & F.exists("vector", lambda x: x != 0))
    vectors = staged(vectors.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    common = vectors.groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    return vectors.filter(F.size("vector") == (common["width"] if common else 0))


def _matrix(lists) -> np.ndarray:
    values = lists.flatten().to_numpy().astype(np.float64)
    return values.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def _top(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple]:
    """For each query its id (repeated), and ids and scores of its ``k`` best among ``vectors``.

    A matrix product finds who can be among them; its rounding differs from place to place, so their scores are
    then added up in one order for all, and equal vectors tie exactly.
    """
    slack = 1e-12 * (1 + np.abs(queries).sum(axis=1) * np.abs(vectors).max(initial=0.0))
    for start in range(0, len(queries), 64):
        scores = queries[start:start + 64] @ vectors.T
        scores[own[start:start + 64, None] == ids[None, :]] = -np.inf
        for i, row in enumerate(scores, start):
            cut = np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -np.inf
            near = np.flatnonzero((row >= cut - slack[i]) & (row > -np.inf))
            exact = np.zeros(len(near))
            for d in range(vectors.shape[1]):
                exact += queries[i, d] * vectors[near, d]
            best = np.lexsort((ids[near], -exact))[:k]
            yield np.full(len(best), own[i]), ids[near][best], exact[best]


def _merged(parts: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query among ``parts``; a vector met in several trees counts once."""
    query, ids, scores = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    fresh = np.ones(len(query), bool)
    fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
    query, ids, scores = query[fresh], ids[fresh], scores[fresh]
    first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]])) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    return query[rank < k], ids[rank < k], scores[rank < k]


def nearest(table: DataFrame, queries=None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            trees: int = TREES, leaf: int = LEAF, visits: int = VISITS, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` nearest by inner product, ties to the smaller id.

    ``queries`` is a condition on ``id``; all other rows (and other queries) are candidates. Rows without an id, and
    vectors that are null, zero, of another length than most, or hold null or non-finite numbers take no part; an id's
    repeated rows count once. An empty table gives no rows; extra columns are ignored.
    """
    spark = table.sparkSession
    rows = usable(table, id_col, vector_col)
    queries = F.expr("id % 20 = 0") if queries is None else queries
    fitted = np.array([np.array(r["vector"]) for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    random = np.random.default_rng(seed)
    forest = [fit_tree(fitted, leaf, random) for _ in range(trees)] if len(fitted) else []
    shared = spark.sparkContext.broadcast(forest)  # bounded by the sample

    def place(batches: Iterable[pa.RecordBatch], walk) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, tree, at = walk(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(tree), pa.array(at),
                                                  batch.column(1).take(pa.array(row))], names=["id", "tree", "leaf", "vector"])

    def homes(batches):
        def walk(x):
            found = [leaves_of(t, x) for t in shared.value]
            return np.tile(np.arange(len(x)), len(found)), np.repeat(np.arange(len(found)), len(x)), np.concatenate(found)
        return place(batches, walk)

    def visited(batches):
        def walk(x):
            found = [(i, t, at) for i, q in enumerate(x) for t, at in search(shared.value, q, visits)]
            return tuple(np.array(c, np.int64) for c in zip(*found))
        return place(batches, walk)

    schema = f"id long, tree long, leaf long, vector {rows.schema['vector'].dataType.simpleString()}"
    members = staged(rows.mapInArrow(homes, schema), "leaves") if forest else rows.sparkSession.createDataFrame([], schema)
    visitors = staged(rows.filter(queries).mapInArrow(visited, schema), "visits") if forest else members
    leaf_key = ["tree", "leaf"]
    sizes = members.groupBy(*leaf_key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("member_blocks")).join(
        visitors.groupBy(*leaf_key).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("query_blocks")), leaf_key)
    # One row per leaf of the forest at most, which the sample bounds.
    sizes = F.broadcast(sizes)

    def dealt(df: DataFrame, own: str, other: str, is_query: bool) -> DataFrame:
        return df.join(sizes, leaf_key).withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"{own}s"))).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1))).select(
            *leaf_key, F.col("member_block").cast("long").alias("mb"), F.col("query_block").cast("long").alias("qb"),
            F.lit(is_query).alias("asks"), "id", "vector")

    unit = [*leaf_key, "mb", "qb"]
    both = dealt(members, "member_block", "query_block", False).unionByName(
        dealt(visitors, "query_block", "member_block", True)).repartition(*unit).sortWithinPartitions(*unit)

    def rank(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], names=["query_id", "vec_id", "score"])

        for run in _runs(batches, unit):
            asks, ids, vectors = run["asks"].astype(bool), run["id"], _matrix(run["vector"])
            if not asks.any() or asks.all():
                continue
            found = list(_top(vectors[asks], ids[asks], vectors[~asks], ids[~asks], k))
            held += found
            rows += sum(len(f[0]) for f in found)
            if rows > 400_000:  # a query's leaves in one task are reduced to its best there
                held = [_merged(held, k)]
                rows = len(held[0][0])
                if rows > 200_000:
                    yield batch()
                    held, rows = [], 0
        if held:
            held = [_merged(held, k)]
            yield batch()

    found = both.mapInArrow(rank, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(
        F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
