"""Packing: ids against the library, places by their own rules, and few sequences."""

import random
import zlib

import numpy as np
import pytest

from skyloom.llm import packing
from skyloom.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def check_places(rows, capacity):
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(v <= capacity for v in at.values())
    return len(at)


def expected(rows, capacity):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    out = []
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            out.append((doc_id, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_pieces_are_the_librarys_ids(odd_docs):
    got = packing.pack_documents(odd_docs, PATH).collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted([tuple(r[:5]) for r in got], key=str) == sorted(expected(rows, 4096), key=str)
    check_places(got, 4096)


def test_plain_letters_are_encoded_once_and_many_at_a_time():
    encoder = packing.WordIds(PATH)
    whole, model, asked = encoder.tokenizer, encoder.plain, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return model.encode_batch_fast(texts, **options)

    encoder.plain, encoder.tokenizer = Counting(), None
    texts = ["plain words stöße garçon", "words plain garçon stöße"]
    assert [*encoder.pack(texts)] == [np.array(whole.encode(t).ids, "<u4").tobytes() for t in texts]
    encoder.tokenizer = whole
    texts = ["plain, words; stöße... garçon!?", "(plain) words' plain's"]
    assert [*encoder.pack(texts)] == [np.array(whole.encode(t).ids, "<u4").tobytes() for t in texts]
    assert asked == ["plain words stöße garçon"]


@pytest.mark.parametrize("limit", [1, 40, 300_000])
def test_words_of_all_kinds_have_the_librarys_ids(limit):
    rng, encoder = random.Random(limit), packing.WordIds(PATH, limit=limit)
    parts = ["plain", "größe", "Été", "ÿ", "×", "÷", "e\u0301", "\u0338", "'s", "'", "’s", "42", "x2", ",", "...", "<", ">", "<|", "|>", "<|endoftext|>",
             "<|EndOfText|>", "</w>", "_", "$#!", "日本", "😀", "İ", "K", "\x00", "\xa0", "\u2028", "\x85", "\x0b", " ", " ", " ", "\n", "\t\f"]
    texts = ["", " ", *("".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(400)), "a" * 3000 + ", b" + "é" * 500 + "."]
    for at in range(0, len(texts), 50):
        some = texts[at:at + 50]
        assert [*encoder.pack(some)] == [
            np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in some]


def test_ids_on_request(docs_of):
    rows = packing.token_pieces(docs_of([(1, "one two three four")]), PATH, capacity=3, with_ids=True).collect()
    assert [len(r["ids"]) for r in rows] == [3, 2] and rows[-1]["ids"][-1] == 1


def test_an_empty_table(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).collect() == []


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_piece_once(seed):
    random.seed(seed)
    capacity = random.choice([7, 30, 128, 4096])
    counts = {random.randint(1, capacity): random.choice([1, 2, 3, 50, 1000]) for _ in range(random.randint(1, 60))}
    sequences, ranks = {}, {}
    for s in packing.plan_slots(counts, capacity):
        for rank in range(s.first, s.last):
            k = rank - s.first
            sequences.setdefault(s.base + k // s.per_bin, []).append((s.at + k % s.per_bin * s.length, s.length))
            assert ranks.setdefault((s.length, rank), s) is s
    assert len(ranks) == sum(counts.values())
    for places in sequences.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end = at + length
        assert end <= capacity
    least = -(-sum(length * n for length, n in counts.items()) // capacity)
    large = sum(n for length, n in counts.items() if 2 * length > capacity)
    assert len(sequences) <= max(least, large) * 1.25 + 2


def test_large_pieces_are_paired_with_the_longest_that_fits():
    slots = packing.plan_slots({60: 2, 40: 1, 35: 1, 10: 2}, 100)
    assert {(s.length, s.base) for s in slots} == {(60, 0), (40, 0), (60, 1), (35, 1), (10, 2)} or len({s.base for s in slots}) <= 3


def test_many_pieces_of_one_length(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 4096L, 7L) AS length",
                                          "id AS ids_crc32")
    placed = packing.pack_pieces(rows).collect()
    assert len({r["doc_id"] for r in placed}) == 20_000
    assert check_places(placed, 4096) == 6667 + -(-13333 // 585)
