"""Centroid clustering of integer vectors by a bisector tournament, exact throughout.

A vector lies nearer to centroid j than to i when it is beyond the plane that halves the way between them, which is the sign
of one linear form: with normal ``2 (c_j - c_i)`` and threshold ``|c_j|^2 - |c_i|^2``, both whole numbers and
computed once for each pair of centroids. Each vector's champion meets the next centroid, and k - 1 such tests leave one; a vector
on the plane stays with the smaller number. Only the distance to the last one is then computed.

Components are whole numbers, so sums and distances have no rounding and do not depend on how rows are dealt. A round moves one
row of sums per task and cluster, whatever the clusters' sizes; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import staged

#: Registered parameters: vector length, scale, clusters and rounds.
WIDTH, SCALE, CLUSTERS, ROUNDS = 64, 64, 16, 3
#: Components up to this size leave room for squared distances in 64 bits; batches with larger ones use Python's numbers.
_PLAIN = 1 << 27
#: Sums are sent in two parts, so that they neither overflow nor round.
_PART = 1 << 60


def usable(vectors: DataFrame, vector_col: str, width: int = WIDTH) -> DataFrame:
    """The rows whose vector has exactly ``width`` components, none null or non-finite."""
    vector = vectors[vector_col]
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce((F.size(vector) == width) & finite, F.lit(False)))


def whole(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles: 64-bit numbers where distances fit them, else Python's numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if not values.size or np.abs(scaled).max() <= _PLAIN:
        return scaled.astype(np.int64)
    exact = [math.floor(x * scale) if abs(x) < 1e300 else int(x) * scale for x in values.ravel().tolist()]
    return np.array(exact + [None], object)[:-1].reshape(values.shape)


def _same_kind(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as 64-bit numbers if both are and the centroids are small, else both as Python's."""
    if vectors.dtype != object and max(map(abs, centroids.ravel().tolist()), default=0) <= _PLAIN:
        return vectors, centroids.astype(np.int64)
    return vectors.astype(object), centroids.astype(object)


class Bisectors:
    """The planes between all pairs of centroids (whole numbers, one row each)."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        squares = (centroids * centroids).sum(axis=1)
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's centroid and squared distance."""
        champion = np.zeros(len(vectors), np.int64)
        for rival in range(1, len(self.centroids)):
            beyond = (vectors * self.normals[champion, rival]).sum(axis=1) > self.thresholds[champion, rival]
            champion[beyond.astype(bool)] = rival
        away = vectors - self.centroids[champion]
        return champion, (away * away).sum(axis=1)


def _vectors(batch: pa.RecordBatch, at: int, width: int, scale: int) -> np.ndarray:
    values = batch.column(at).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return whole(values.reshape(batch.num_rows, width), scale)


def first_centroids(vectors: DataFrame, id_col: str, vector_col: str, k: int, scale: int = SCALE) -> np.ndarray:
    """The ``k`` usable vectors whose ids' digests (sha256 of ``1:<id>``) are smallest, in that order.

    Rows that repeat an id come in the order of their vectors; a null id counts as empty text.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(vectors[id_col].cast("string"), F.lit(""))), 256)
    rows = vectors.select(digest.alias("digest"), vectors[vector_col].alias("vector")).orderBy("digest", "vector").limit(k).collect()
    return whole(np.array([r["vector"] for r in rows], np.float64), scale)


def _moved(vectors: DataFrame, vector_col: str, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The centroids after one round: the floor of each cluster's mean, component by component; empty clusters stay."""
    k, width = centroids.shape
    source = vectors.select(vectors[vector_col].alias("vector"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[bool, Bisectors] = {}
        sums, counts = np.zeros((k, width), object), np.zeros(k, np.int64)
        for batch in batches:
            rows, own = _same_kind(_vectors(batch, 0, width, scale), centroids)
            if not len(rows):
                continue
            kind = rows.dtype == object
            if kind not in planes:
                planes[kind] = Bisectors(own)
            cluster, _ = planes[kind].nearest(rows)
            for c in np.unique(cluster):
                sums[c] += rows[cluster == c].sum(axis=0).astype(object)
            counts += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(counts)
        parts = [[int(x) // _PART for c in some for x in sums[c]], [int(x) % _PART for c in some for x in sums[c]]]
        # One row for each cluster and component.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, width), pa.int32()), pa.array(np.tile(np.arange(width), len(some)), pa.int32()),
             pa.array(np.repeat(counts[some], width), pa.int64()), *[pa.array(list(map(str, p)), pa.string()) for p in parts]],
            names=["cluster", "component", "n", "high", "low"])

    totals = source.mapInArrow(run, "cluster int, component int, n long, high string, low string").groupBy("cluster", "component").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")])
    moved = centroids.astype(object)
    for r in totals.collect():  # k * width rows
        moved[r["cluster"], r["component"]] = (int(r["high"]) * _PART + int(r["low"])) // r["n"]
    return moved


def centroid_clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS,
                      rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    Vectors that are null, have another number of components or hold a null or non-finite one take no part. With fewer than
    ``k`` usable vectors there are as many centroids as vectors; without any there are no rows. Rows that repeat an
    id or a vector count each; null ids stay; extra columns are ignored. Equally near centroids: the smaller
    number. Distances are squared; where one, or their sum, passes 64 bits it is null.
    """
    kept = usable(vectors, vector_col, width).select(vectors[id_col].alias("vec_id"), vectors[vector_col].alias("vector"))
    centroids = first_centroids(kept, "vec_id", "vector", k, scale)
    key = kept.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return kept.select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    for _ in range(rounds):
        centroids = _moved(kept, "vector", centroids, scale)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[bool, Bisectors] = {}
        for batch in batches:
            rows, own = _same_kind(_vectors(batch, 1, width, scale), centroids)
            kind = rows.dtype == object
            if kind not in planes:
                planes[kind] = Bisectors(own)
            cluster, distance = planes[kind].nearest(rows)
            fits = [int(d) if d < 1 << 63 else None for d in distance.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cluster, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = staged(kept.mapInArrow(run, f"vec_id {key}, cluster int, distance long"), "clusters")
    # A cluster with a distance that has no number has no inertia either.
    total = lambda: F.when(F.count("distance") == F.count(F.lit(1)), F.try_sum("distance"))
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(total().alias("s")).collect()}  # k rows
    whole_sum = None if None in sums.values() else sum(sums.values())
    if whole_sum is not None and whole_sum >= 1 << 63:
        whole_sum = None
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]
    of = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("cluster") + 1)
    return assigned.select(
        "vec_id", "cluster", "distance", of([sums.get(c) for c in range(len(centroids))], "long").alias("cluster_inertia"),
        F.lit(whole_sum).cast("long").alias("inertia"), of(digests, "string").alias("centroid_sha256"))
