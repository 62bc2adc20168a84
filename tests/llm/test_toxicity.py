"""Toxicity: held-out accuracy with unseen misspellings, and odd rows."""

import base64
import math
import random
import zlib

import pytest

from skyloom.llm import toxicity

BAD = ["grumblefoot", "snotgoblin", "wretchling"]


def made(n, seed):
    random.seed(seed)
    syllables = ["ba", "co", "di", "fe", "gu", "la", "mo", "ne", "ri", "su", "ta", "vo"]
    texts, labels = [], []
    for i in range(n):
        words = ["".join(random.choices(syllables, k=random.randint(1, 4))) for _ in range(random.randint(5, 120))]
        toxic = i % 4 == 0
        for _ in range(max(1, len(words) // 40) if toxic else 0):
            word = random.choice(BAD)
            at = random.randrange(len(word) - 1)
            words.insert(random.randrange(len(words)), word[:at] + random.choice(["", "x", word[at].upper()]) + word[at + 1:])
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return toxicity.fit(*made(600, 1))


def test_held_out_accuracy_with_misspellings(model):
    texts, labels = made(400, 2)
    scorer = toxicity.Scorer(model)
    right = [(scorer.score(t) >= 0.7) == bool(y) for t, y in zip(texts, labels)]
    assert sum(right) >= 0.95 * len(right)


def test_a_long_clean_text_does_not_hide_a_toxic_word(model):
    scorer = toxicity.Scorer(model)
    clean = " ".join(t for t, y in zip(*made(60, 3)) if not y)
    assert scorer.score(clean) < 0.7 <= scorer.score(clean + " grumblefoot snotgoblin " + clean)


def test_words_run_together(model):
    scorer = toxicity.Scorer(model)
    assert scorer.score("grumblefootsnotgoblin" * 5) >= 0.7
    texts, labels = made(400, 2)
    called = [(scorer.score(t.replace(" ", "")) >= 0.7, y) for t, y in zip(texts, labels)]
    assert sum(c for c, y in called if y) >= 0.6 * sum(labels) and not sum(c for c, y in called if not y)
    # Every n-gram of a long word lies within a stretch.
    word = bytes(random.Random(1).choices(b"abcdefgh", k=301))
    parts = toxicity.words_of(word.decode())
    assert all(any(word[i:i + toxicity.LONGEST] in p for p in parts) for i in range(len(word) - toxicity.LONGEST + 1))


def test_scores_do_not_depend_on_what_was_scored_before(model, monkeypatch):
    texts, _ = made(50, 4)
    whole = [toxicity.Scorer(model).score(t) for t in texts]
    monkeypatch.setattr(toxicity, "CACHED_WORDS", 10)
    scorer = toxicity.Scorer(model)
    assert [scorer.score(t) for t in texts] == whole


def test_rows_and_held_out(odd_docs, docs_of, spark):
    texts, labels = made(240, 5)
    docs = odd_docs.select("doc_id", "text").unionByName(docs_of([(100 + i, t) for i, t in enumerate(texts)]))
    table = spark.createDataFrame([(100 + i, y) for i, y in enumerate(labels)] + [(1, None), (None, 1), (3, 7)], "doc_id long, toxic int")
    rows = toxicity.toxicity(docs, table).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
    # Labels of the held-out third change nothing.
    other = spark.createDataFrame([(100 + i, y if zlib.crc32(str(100 + i).encode()) % 3 != 1 else 1 - y) for i, y in enumerate(labels)],
                                  "doc_id long, toxic int")
    assert sorted(map(str, toxicity.toxicity(docs, other).collect())) == sorted(map(str, rows))
    kept = toxicity.drop_toxic(odd_docs, table)
    assert kept.columns == odd_docs.columns


def test_empty_tables(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs_of([]), none).collect() == []
    assert [r["score"] for r in toxicity.toxicity(docs_of([(1, "a"), (2, None)]), none).collect()] == [0.5, 0.5]


def plain_score(model, text):
    """The score by plain loops: windows of eight distinct words, their mean numbers, a soft maximum lowered by their number."""
    words, seen = [], set()
    for word in "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in text).split():
        word = b"<" + bytes(c | 32 if 65 <= c <= 90 else c for c in word.encode()) + b">"
        long = len(word) > toxicity.LONG
        for part in [word[i:i + 16] for i in range(0, len(word) - 5, 11)] if long else [word]:
            if part not in seen:
                seen.add(part)
                words.append(part)
    numbers = []
    for word in words:
        grams = [word] + [word[i:i + n] for n in range(3, 7) for i in range(len(word) - n + 1)]
        parts = [float(model.parts[zlib.crc32(g) % toxicity.BUCKETS]) for g in grams]
        known = sum(p != 0 for p in parts)
        numbers.append(sum(parts) / max(len(parts), 12) * min(1, known / (0.25 * len(parts))))
    windows = [sum(numbers[i:i + 8]) / 8 + model.bias for i in range(0, len(numbers), 8)] or [model.bias]
    odds = math.log(sum(math.exp(w) for w in windows)) - math.log(1 + (len(windows) - 1) / 50)
    return 1 / (1 + math.exp(-odds))


def test_scores_by_plain_loops(model):
    scorer = toxicity.Scorer(model)
    texts = made(60, 9)[0] + ["", "a", "Straße ÉTÉ 数据", "x" * 700, "grumblefoot " * 30, "co-di_fe ba'la"]
    for text in texts:
        assert abs(scorer.score(text) - plain_score(model, text)) < 1e-6


def test_length_alone_decides_nothing(model):
    scorer = toxicity.Scorer(model)
    texts, labels = made(200, 6)
    for text, toxic in zip(texts, labels):
        assert scorer.score(" ".join([text] * 200)) == scorer.score(text)
    clean = " ".join(made(400, 7)[0][i] for i in range(400) if i % 4)
    assert scorer.score(clean) < 0.7
    numbers = random.Random(1)
    for size in (500, 30_000, 200_000):
        assert not any(scorer.score(base64.b64encode(numbers.randbytes(size)).decode()) >= 0.7 for _ in range(5))
