"""Registered queries: SQL where there is some, shapes where there is none, and the pipeline's stages by brute force."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from skyloom.llm import oracle, queries, toxicity
from skyloom.llm.common import staged
from tests.compare import connect, differences
from tests.llm.test_exact_dedup import brute as exact_groups
from tests.llm.test_jaccard_join import brute as near_groups
from tests.llm.test_packing import check_places, expected
from tests.llm.test_pii import PLAIN, valid

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
    assert set(oracle.SQL) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_against_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), oracle.SQL[name]) is None


@pytest.mark.parametrize("name", ["op3_pii", "op6_exact_dedup", "op10_warc_derivatives"])
def test_native_plans_have_no_python(spark, name):
    text = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_pipeline_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns = docs.columns
    texts = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, SF), "stage")
        before, now = dict(texts(docs)), after
        if name == "toxicity":
            scores = toxicity.toxicity(docs, queries.table(spark, SF, "labels"))
            assert {i for i, _ in texts(after)} == {r["doc_id"] for r in scores.filter("predicted = 0").collect()}
        elif name == "exact dedup":
            assert {i for i, _ in texts(after)} == {d for d, _, _, kept, _ in exact_groups(list(before.items())) if kept}
        elif name == "n-gram Jaccard join":
            assert {i for i, _ in texts(after)} == {c for _, _, c in near_groups(list(before.items()), 5, 80)}
        elif name == "PII":
            import re

            assert {i for i, _ in texts(after)} == set(before)
            for doc_id, text in texts(after):
                for kind, pattern in PLAIN.items():
                    if kind != "card":  # what is left of a number beside a redacted one may by chance pass the check
                        found = [m[0] for m in re.finditer(pattern, before[doc_id]) if valid(kind, m[0])]
                        assert not any(f in text for f in found)
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        else:
            rows = after.collect()
            assert sorted(tuple(r)[:5] for r in rows) == sorted(expected(list(before.items()), 4096))
            check_places(rows, 4096)
        if name != "best-fit packing":
            assert after.columns == columns
        docs = now
