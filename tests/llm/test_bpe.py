"""The backtracking encoder against the library, and exact round trips."""

import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import bpe
from skyloom.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abthe  'sS\n\t.,12é", max_size=60)))
def test_any_text(text):
    own = bpe.vocabulary(PATH)
    ids, decimal = own.encode(text)
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert decimal == ",".join(map(str, ids.tolist())) and own.decode(ids) == text.encode()


def test_odd_rows(odd_docs):
    got = sorted(bpe.round_trip_digests(odd_docs, PATH).collect(), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = []
    for r in odd_docs.collect():
        ids = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        expected.append((r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_encode_and_decode_tables(docs_of):
    docs = docs_of([(1, "Hello  there\n"), (2, None)])
    decoded = bpe.decode_documents(bpe.encode_documents(docs, PATH), PATH)
    assert sorted(map(tuple, decoded.collect())) == [(1, "Hello  there\n"), (2, "")]


def test_an_empty_table(docs_of):
    assert bpe.round_trip_digests(docs_of([]), PATH).collect() == []


def test_long_runs():
    own = bpe.vocabulary(PATH)
    for text in ["x" * 20_000, " " * 9000 + "a", "あ" * 5000, "ab" * 8000]:
        assert own.encode(text)[0].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
