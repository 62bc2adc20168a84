"""The join's components against counting shared shingles of all pairs."""

import collections
import random
import re

import pytest

from skyloom.llm import components, jaccard_join
from skyloom.llm.common import LOWER, UPPER


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)] if words else [])


def brute(rows, words=4, percent=85):
    sets = [shingles(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in enumerate(sets):
        met = collections.Counter(j for s in own for j in holders[s])
        for j, shared in met.items():
            if 100 * shared >= percent * (len(own) + len(sets[j]) - shared):
                root[find(j)] = find(i)
        for s in own:
            holders[s].append(i)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        known = smallest.setdefault(find(i), doc_id)
        if doc_id is not None and (known is None or doc_id < known):
            smallest[find(i)] = doc_id
    return sorted(((d, len(sets[i]), smallest[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def near_copies(seed):
    random.seed(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    passage = random.choices(vocabulary, k=30)
    texts = []
    for n in [5, 8, 12, 14, 18, 25, 40, 90]:
        for _ in range(3):
            base = random.choices(vocabulary, k=n)
            for _ in range(8):
                own = list(base)
                for _ in range(random.choice([0, 0, 1, 2, max(1, n // 30)])):
                    at = random.randrange(len(own))
                    own[at:at + random.choice([0, 1])] = random.choices(vocabulary, k=random.choice([0, 1])) if len(own) > 1 else own
                texts.append(" ".join(own))
    texts += [" ".join(passage + random.choices(vocabulary, k=random.choice([5, 30, 80]))) for _ in range(60)]
    big = random.choices(vocabulary, k=120)
    for _ in range(90):
        own = list(big)
        for _ in range(random.choice([1, 2, 3, 4])):
            own[random.randrange(len(own))] = random.choice(vocabulary)
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [
    {}, {"BLOCK_SETS": 16, "HEAVY_LIST": 4}, {"LIGHT_MOST": 0, "FILTER_BITS": 64}, {"BLOCK_SHINGLES": 2000, "HEAVY_LIST": 10}])
def test_components(docs_of, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(len(settings))
    got = jaccard_join.jaccard_components(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_five_words_and_four_fifths(docs_of):
    rows = near_copies(9)
    got = jaccard_join.jaccard_components(docs_of(rows), words=5, percent=80).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 5, 80)


def test_near_copies_around_a_frequent_passage(docs_of):
    """Frequent shingles move to the end, so sets list shingles beyond those that they counted."""
    passage = [f"p{i}" for i in range(33)]
    texts = [" ".join(passage + [f"only{i}_{k}" for k in range(5)]) for i in range(70)]
    for i in range(400):
        n = 12 + i % 22
        base = passage[:n] + [f"b{i}_{k}" for k in range(n)]
        size = 2 * n - 3
        changed = max(d for d in range(size) if 100 * (size - d) >= 85 * (size + d))  # just a link
        texts += [" ".join(base), " ".join(base[:2 * n - changed] + [f"c{i}_{k}" for k in range(changed)])]
    rows = list(enumerate(texts))
    got = jaccard_join.jaccard_components(docs_of(rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = jaccard_join.jaccard_components(odd_docs).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    kept = jaccard_join.one_of_each_component(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute(rows)}


def test_an_empty_table(docs_of):
    assert jaccard_join.jaccard_components(docs_of([])).collect() == []


def test_boundary_follows_the_cost_of_lists():
    assert jaccard_join.light_boundary(0, 85) < jaccard_join.light_boundary(5, 85) <= jaccard_join.LIGHT_MOST


def test_components_of_paths_stars_and_rings(spark):
    random.seed(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1300)] + [(2000 + i, 2000 + (i + 1) % 50) for i in range(50)]
    edges += [(5, 5), (1, 0)]
    random.shuffle(edges)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == (0 if i < 1000 else 1000 if i < 2000 else 2000) for i in found)
    assert len(found) == 201 + 300 + 50
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
