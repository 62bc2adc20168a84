"""Alignment of two tokenizations against a brute-force version."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from skyloom.llm import alignment
from skyloom.llm.queries import QUERIES
from skyloom.llm.tokens import byte_level, pieces

A, RANKS, B = (public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, portion int, a string"


def tokens(text):
    """(id, start, end) of both tokenizers, by their libraries alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    from skyloom.llm.bpe import byte_alphabet

    first, second = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    alphabet = byte_alphabet()
    both = []
    ids = first.encode(" " + text, add_special_tokens=False)
    both.append([(i, bytes(alphabet[c] for c in t)) for i, t in zip(ids.ids, ids.tokens)])
    both.append([(i, bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
                 for i in second.encode(text) for p in [second.id_to_piece(i)]])
    placed = []
    for own in both:
        if b"".join(raw for _, raw in own) != (" " + text).encode():
            return [], []
        at, out = 0, []
        for i, raw in own:
            out.append((i, at, at + len(raw)))
            at += len(raw)
        placed.append(out)
    return placed


def brute_force(rows):
    links, docs = {}, Counter()
    for n, (_, text) in enumerate(rows):
        a, b = tokens(text) if text else ([], [])
        links[n] = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        docs.update(set(links[n]))
    most = defaultdict(int)
    for (x, _), count in docs.items():
        most[x] = max(most[x], count)
    out = []
    for n, (doc, text) in enumerate(rows):
        a, b = tokens(text) if text else ([], [])
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, last = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in own if last <= s and e <= end) for own in (a, b)))
            last = end
        out.append((doc, len(a), len(b), len(ends), len(links[n]), sum(docs[p] == most[p[0]] for p in links[n]),
                    sum(docs[p] for p in links[n]), hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    return out


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
                                               "groups_sha256").collect()], key=str)


def test_against_brute_force(spark):
    random.seed(3)
    words = "the of and Straße naïve token <|endoftext|> <0x41> <s> 数据 42 3.14 don't \n \t  ▁ — été ' 😀 aaaaaaaa zqxj".split(" ")
    rows = [(i, " ".join(random.choices(words, k=random.randint(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " "), (103, "a▁b"), (104, "same text"), (104, "same text"), (None, "no id"),
             (105, "\0\x01\r\n"), (106, " leading"), (107, "trailing  ")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    assert rows_of(alignment.align_documents(df, A, B, RANKS)) == sorted(brute_force(rows), key=str)
    assert rows_of(alignment.align_documents(df, A, B)) == sorted(brute_force(rows), key=str)


def test_empty_tables_and_texts_without_tokens(spark):
    assert rows_of(alignment.align_documents(spark.createDataFrame([], SCHEMA), A, B)) == []
    df = spark.createDataFrame([(1, None, 1, ""), (2, "", 1, ""), (3, "▁", 1, "")], SCHEMA)
    assert rows_of(alignment.align_documents(df, A, B)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)]


def test_very_long_texts(spark):
    text = "word " * 100_000 + " " * 300_000 + "x" * 300_000
    got = rows_of(alignment.align_documents(spark.createDataFrame([(1, text, 1, ""), (2, "word", 1, "")], SCHEMA), A, B, RANKS))
    assert got[0][1] > 100_000 and got[0][4] == got[0][1] + got[0][2] - got[0][3]


def test_galloping_finds_lower_bounds():
    random.seed(1)
    hay = np.array(sorted(random.sample(range(1000), 200)) + [1000])
    keys = np.array(sorted(random.choices(range(1001), k=300)))
    low, high = np.zeros(300, np.int64), np.full(300, 201)
    for start in (np.zeros(300, np.int64), np.full(300, 200), np.array([random.randrange(201) for _ in range(300)])):
        assert alignment.gallop(keys, hay, low, high, start).tolist() == np.searchsorted(hay, keys).tolist()


@pytest.mark.parametrize("text", ["plain words, and more", "Größe — naïve", "数据 😀", "", " ", "<|endoftext|>" * 3])
def test_both_encoders_agree_and_bytes_come_back(text):
    ids = byte_level(A).encode([text])
    assert byte_level(A, RANKS).encode([text]) == ids
    assert byte_level(A).bytes.join(np.array(ids[0], np.int64)) == text.encode()
    assert pieces(B).bytes.join(np.array(pieces(B).encode([text])[0], np.int64)) in (b" " * bool(text) + text.encode(), b"")


def test_links_are_tokens_less_groups(spark):
    for r in QUERIES["op13_cross_tokenizer"](spark, "/root/testdata/sf0.001").collect():
        assert r.n_links == r.n_a + r.n_b - r.n_groups and 0 <= r.n_best <= r.n_links <= max(r.count_sum, 0)
