"""Exact duplicates against a dictionary of normalised texts, also where chunk digests collide."""

import hashlib

import pytest
from pyspark.sql import functions as F

from skyloom.llm import exact_dedup
from skyloom.llm.common import LOWER, UPPER


def brute(rows):
    fold = lambda t: (t or "").translate(str.maketrans(UPPER, LOWER))
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(fold(text), []).append(doc_id)
    out = []
    for doc_id, text in rows:
        own = groups[fold(text)]
        keep = max((i for i in own if i is not None), default=None)
        out.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256(fold(text).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digest", [None, lambda chunk: F.xxhash64(chunk) % 2, lambda chunk: F.lit(7).cast("long")])
def test_odd_rows_and_colliding_digests(odd_docs, docs_of, digest):
    more = [(100 + i, t) for i, t in enumerate(["A sentence. " * 200 + c for c in "aAbb"] + ["é" * 5000, "É" * 5000, "é" * 5000])]
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()] + more
    docs = odd_docs.select("doc_id", "text").unionByName(docs_of(more))
    got = exact_dedup.exact_duplicates(docs, **({"digest": digest} if digest else {}))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_one_row_of_each_group_stays_with_all_columns(odd_docs):
    kept = exact_dedup.drop_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted({b[1] for b in brute(rows)}, key=str)


def test_an_empty_table(docs_of):
    assert exact_dedup.exact_duplicates(docs_of([])).collect() == []


def test_chunks_put_the_text_together_again(spark):
    text = ("One sentence. Another one!\n" * 300) + "y" * 9000
    chunks = spark.createDataFrame([(text,)], "t string").select(
        F.regexp_extract_all("t", F.lit(exact_dedup.CHUNK), F.lit(0))).first()[0]
    assert "".join(chunks) == text and max(map(len, chunks)) <= 4096
