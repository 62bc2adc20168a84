"""Secrets: the base grammar against the plain definition, and novelty."""

import hashlib
import random
import re
import string

from skyloom.llm import secrets

KEYWORDS = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in (
    "password", "passwd", "secret", "token", "api_?key")) + ")"
PLAIN = [KEYWORDS + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", r"(AKIA[A-Z0-9]+)", r"([0-9a-f]+)"]


def brute(text):
    least = (8, 16, 32)
    found = sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text or "") if len(m[1]) >= least[k])
    joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)
    return [sum(k == i for _, k, _ in found) for i in range(3)], hashlib.sha256(joined.encode()).hexdigest(), joined


def test_base_spans(odd_docs, docs_of):
    random.seed(6)
    parts = ["token", "Secret", "api_key", "APIKEY", "=", ": ", " ", '"', "abcdefgh", "é😀", "deadbeef" * 4, "AKIA", "ABCDEFGH12345678", "\n", "ſecret=longenough"]
    rows = [(100 + i, "".join(random.choices(parts, k=random.randint(0, 14)))) for i in range(1500)]
    docs = odd_docs.select("doc_id", "text").unionByName(docs_of(rows))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = secrets.find_secrets(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        counts, digest, joined = brute(texts[r["doc_id"]])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == counts and r["base_sha256"] == digest
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))


def test_novel_strings_are_reported_and_repeated_ones_are_not(docs_of):
    random.seed(8)
    key = "".join(random.choices(string.ascii_letters + string.digits, k=40))
    known = "connection_pool_manager_v2_default"
    rows = [(1, f"the bearer is {key} here"), (2, f"{known} {known} the bearer is {known} here"), (3, f"nothing near {key}")]
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs_of(rows)).collect()}
    assert found == {1: "novel:14:54", 2: "", 3: ""}


def test_long_keys_are_measured_whole(docs_of):
    random.seed(9)
    texts = {size: "Authorization: Bearer " + "".join(random.choices(string.ascii_letters + string.digits, k=size)) + " end"
             for size in (256, 257, 300, 5000, 300_000)}
    found = {r["doc_id"]: r["spans"] for r in secrets.find_secrets(docs_of(list(texts.items()))).collect()}
    assert found == {size: f"novel:22:{22 + size}" for size in texts}
    repeated = "the bearer is " + "connection_pool_v2_" * 40
    assert secrets.find_secrets(docs_of([(1, repeated)])).first()["spans"] == ""


def test_an_empty_table(docs_of):
    assert secrets.find_secrets(docs_of([])).collect() == []


def test_candidates_lie_outside_all_base_spans():
    # One long base span with nine others inside it, and a string at its end.
    text = "secret=" + ".".join(["0123456789abcdef0123456789abcdef"] * 9) + ".Zq9Zq9Zq9Zq9Zq9Zq9"
    base = secrets.base_spans(text)
    assert len(base) == 10 and secrets.candidates(text, base) == []
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice(["secret=", "token ", "abcdef12", "0" * 32, "Zq9", ".", " ", "AKIA" + "B" * 16]) for _ in range(30))
        base = secrets.base_spans(text)
        found = secrets.candidates(text, base)
        assert not any(s < end and start < e for start, end, _ in found for s, _, e in base)
        free = [m for m in secrets.CANDIDATE.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base)]
        near = [m.start() for m in secrets.SENSITIVE.finditer(text)]
        assert [f[0] for f in found] == [m.start() for m in free if any(0 < m.start() - n <= secrets.NEAR for n in near)
                                         and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]


def test_novelty_by_the_plain_measure(docs_of):
    """Each candidate's new bytes, measured anew with the dictionary that the query makes."""
    import zstandard

    key = "".join(random.Random(3).choices("ABCDEFGHJKLMNPQRSTabcdefghijkmnpqrst23456789", k=40))
    rows = [(1, f"Authorization: Bearer {key} end"), (2, "bearer_of_news1 bearer_of_news1 token bearer_of_news1xx"), (3, "no key"), (4, None)]
    docs = docs_of(rows)
    primer = secrets.identifier_dictionary(secrets.scan(docs))
    compressor = zstandard.ZstdCompressor(level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
        primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    for r in secrets.find_secrets(docs).collect():
        text = dict(rows)[r["doc_id"]] or ""
        novel = []
        for start, end, around in secrets.candidates(text, secrets.base_spans(text)):
            size = lambda s: len(compressor.compress(s.encode()))
            new = size(around + text[start:end]) - size(around)
            if new >= secrets.NEW_BYTES and new >= secrets.NEW_SHARE * (end - start):
                novel.append(f"novel:{start}:{end}")
        assert r["n_novel"] == len(novel) and set(novel) == {s for s in r["spans"].split(",") if s.startswith("novel")}
        assert r["doc_id"] != 1 or novel == [f"novel:22:{22 + len(key)}"]
