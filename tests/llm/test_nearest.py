"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from skyloom.llm import nearest


def brute(ids, vectors, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        scores = sum(vectors[q, d] * vectors[:, d] for d in range(vectors.shape[1]))
        order = np.lexsort((ids, -scores))
        out[ids[q]] = [(ids[i], scores[i]) for i in order if ids[i] != ids[q]][:k]
    return out


def rows_of(spark, ids, vectors):
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark):
    random = np.random.default_rng(3)
    vectors = random.standard_normal((3000, 24)).astype(np.float32).astype(np.float64)
    ids = random.permutation(6000)[:3000]
    expected, hits = brute(ids, vectors), 0
    got = nearest.nearest(rows_of(spark, ids, vectors), visits=200).collect()
    exact = {(q, i): s for q, found in expected.items() for i, s in found}
    for q in expected:
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert [(-r["score"], r["vec_id"]) for r in own] == sorted((-r["score"], r["vec_id"]) for r in own)
        hits += sum((q, r["vec_id"]) in exact for r in own)
        assert all(abs(r["score"] - exact[q, r["vec_id"]]) < 1e-9 for r in own if (q, r["vec_id"]) in exact)
    assert hits >= 0.9 * 20 * len(expected)


def test_equal_vectors_tie_to_smaller_ids(spark):
    random = np.random.default_rng(5)
    vectors = np.repeat(random.standard_normal((40, 8)).astype(np.float32).astype(np.float64), 50, axis=0)
    ids = random.permutation(2000)
    expected = brute(ids, vectors)
    got = {}
    for r in nearest.nearest(rows_of(spark, ids, vectors), visits=10**6, leaf=8).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert {q: [i for _, i in sorted(own.items())] for q, own in got.items()} == {q: [i for i, _ in f] for q, f in expected.items()}


def test_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]),
            (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (20, [0.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS tree", "3 AS score")
    got = sorted(map(tuple, nearest.nearest(table).collect()))
    assert got == [(0, 1, 1, 0.5), (0, 2, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 0, 0.0)]
    assert nearest.nearest(table.limit(0)).collect() == []


@pytest.mark.parametrize("block", [16, 4096])
def test_blocks_of_hot_leaves(spark, monkeypatch, block):
    monkeypatch.setattr(nearest, "BLOCK", block)
    vectors = np.tile(np.array([[1.0, 2.0]]), (400, 1))
    ids = np.arange(400)
    got = nearest.nearest(rows_of(spark, ids, vectors)).collect()
    assert sorted(r["vec_id"] for r in got if r["query_id"] == 40) == list(range(20)) and len(got) == 400
