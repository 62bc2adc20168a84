"""What a Python worker holds: one operator's words at a time, and little beside the texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from skyloom.llm import common, jaccard_join, packing, shingles, toxicity
from skyloom.llm.queries import vocabulary

BATCH = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words to keep", "others to keep"]})
TASKS = {
    "toxicity": lambda docs: toxicity.score_documents(docs, toxicity.fit([], [])),
    "frequent shingles": lambda docs: jaccard_join.frequencies(jaccard_join._keyed(docs, "doc_id", "text"), 5, 80),
    "sketches": lambda docs: jaccard_join.sketches(jaccard_join._keyed(docs, "doc_id", "text"), 5, 80, 0, jaccard_join.Frequencies(
        np.zeros(0, np.uint64), np.zeros(1, np.uint64), 0.0)),
}


@pytest.mark.parametrize("name", TASKS)
def test_a_task_frees_what_the_operator_before_has_kept(docs_of, monkeypatch, name):
    docs = docs_of([(1, "some words to keep"), (2, "others to keep")])
    tasks, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, task, *a: tasks.append(task) or plain(df, task, *a))
    packing.token_pieces(docs, vocabulary("word_bpe_49k.json"))
    TASKS[name](docs)
    pack, task = tasks[:2]
    list(pack(iter([BATCH])))
    assert [key[0] for key in common._KEPT] == ["packing"]
    list(task(iter([BATCH.select(["text"]) if name == "frequent shingles" else BATCH])))
    assert not common._KEPT


def test_one_thing_is_kept_at_a_time():
    first = common.kept("a", lambda: [1])
    assert common.kept("a", lambda: [2]) is first
    assert common.kept("b", lambda: [3]) == [3] and list(common._KEPT) == ["b"]
    common.let_go()


def test_shingling_holds_a_small_multiple_of_its_text():
    random.seed(4)
    texts = [" ".join(random.choices(["alpha", "beta", "gamma", "delta", "to", "of"], k=4000)) for _ in range(180)]
    size = sum(map(len, texts))
    tracemalloc.start()
    try:
        shingles.shingle(texts, 5)
        assert tracemalloc.get_traced_memory()[1] < 15 * size
    finally:
        tracemalloc.stop()
