"""Centroid clustering against a brute-force version in Python's numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from skyloom.llm.centroids import Bisectors, centroid_clusters

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance date, vector int"


def brute_force(rows, k, rounds, width=64, scale=64):
    kept = [(i, [math.floor(scale * x) if abs(x) < 1e300 else int(x) * scale for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    away = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c))
    nearest = lambda v: min(range(len(centroids)), key=lambda c: (away(v, centroids[c]), c))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        centroids = [[sum(col) // len(col) for col in zip(*[v for (_, v), o in zip(kept, own) if o == c])] or centroids[c]
                     for c in range(len(centroids))]
    placed = [(i, nearest(v), v) for i, v in kept]
    rows = [(i, c, away(v, centroids[c])) for i, c, v in placed]
    fit = lambda x: x if x is not None and x < 1 << 63 else None
    sums = {c: fit(sum(d for _, o, d in rows if o == c)) for _, c, _ in rows}
    everything = fit(sum(d for _, _, d in rows))
    text = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    return sorted([(i, c, fit(d), sums[c], everything, text(c)) for i, c, d in rows], key=str)


def clustered(spark, rows, k=16, rounds=3, width=64, parts=5):
    df = spark.createDataFrame([(i, v, None, "x", None, 1) for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, centroid_clusters(df, k=k, rounds=rounds, width=width).collect()), key=str)


def test_against_brute_force(spark):
    random.seed(5)
    rows = [(i, [random.gauss(i % 7, 0.4) for _ in range(64)]) for i in range(300)]
    rows += [(i, rows[3][1]) for i in range(300, 340)] + [(3, rows[3][1]), (None, rows[5][1]), (None, rows[6][1])]  # copies
    rows += [(400, None), (401, []), (402, [1.0] * 63), (403, [1.0] * 65), (404, [1.0] * 63 + [None]),
             (405, [float("nan")] + [1.0] * 63), (406, [float("inf")] * 64), (407, [0.0] * 64), (408, [-0.0] * 64)]
    assert clustered(spark, rows) == brute_force(rows, 16, 3)


def test_ties_go_to_the_smaller_number(spark):
    # Whole numbers in few places: many vectors lie on the planes.
    random.seed(6)
    rows = [(i, [random.randint(-1, 1) / 64 for _ in range(3)]) for i in range(200)]
    assert clustered(spark, rows, k=6, width=3) == brute_force(rows, 6, 3, width=3)


@pytest.mark.parametrize("size", [1e8, 1e20, 1e200, 1.7e308])
def test_large_components_are_exact(spark, size):
    random.seed(7)
    rows = [(i, [random.uniform(-size, size) for _ in range(4)]) for i in range(30)]
    if size > 1e150:  # beyond what sums of decimals hold: one round's means are not needed
        assert clustered(spark, rows, k=4, rounds=0, width=4) == brute_force(rows, 4, 0, width=4)
    else:
        assert clustered(spark, rows, k=4, width=4) == brute_force(rows, 4, 3, width=4)


def test_few_vectors_and_none(spark):
    assert clustered(spark, []) == []
    assert clustered(spark, [(1, None), (2, [1.0])]) == []
    rows = [(1, [0.5] * 64), (2, [0.25] * 64)]
    assert clustered(spark, rows) == brute_force(rows, 16, 3)


def test_the_tournament_finds_the_nearest():
    random.seed(8)
    numbers = np.random.default_rng(1)
    centroids, vectors = numbers.integers(-3, 4, (9, 5)), numbers.integers(-3, 4, (500, 5))
    cluster, distance = Bisectors(centroids).nearest(vectors)
    squares = ((vectors[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert cluster.tolist() == squares.argmin(axis=1).tolist() and distance.tolist() == squares.min(axis=1).tolist()
