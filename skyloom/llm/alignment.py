"""Alignment of two tokenizations of one text by their token ends.

Both tokenizations spell the same bytes, so each is an ascending list of end offsets whose last numbers agree. The
shorter list drives: each of its ends gallops through the longer one, in steps that double until they pass it, and binary
search closes the bracket. Ends found in both lists cut the tokens into groups. The ranks found on the way also say which
tokens overlap: a driving token reaches from the rank of its start to that of its end.

How many documents link a pair of ids is known only when all are read. A task counts each portion of some 2 MB of text by
itself and numbers the portion's distinct pairs. Portions' pairs meet the counts of the whole corpus in a shuffled join,
and each portion's documents then look their numbers up: what is held at a time is bounded by a portion, or one longer text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import id_and_text, portions, staged, texts_of
from skyloom.llm.tokens import byte_level, pieces

#: Bytes of text that a task aligns at a time; a longer text is a portion of its own.
PORTION = 1 << 21


def gallop(keys: np.ndarray, hay: np.ndarray, low: np.ndarray, high: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each key the first place in ``hay[low:high]`` whose number is not smaller; ``hay[high - 1]`` never is.

    All keys gallop side by side, each from its own ``start``.
    """
    upward = hay[start] < keys
    below, found = np.where(upward, start, low - 1), np.where(upward, high - 1, start)
    going, step = np.flatnonzero(found - below > 1), 1
    while len(going):
        up = upward[going]
        probe = np.where(up, np.minimum(start[going] + step, high[going] - 1), np.maximum(start[going] - step, low[going]))
        less = hay[probe] < keys[going]
        below[going[less]], found[going[~less]] = probe[less], probe[~less]
        going = going[(less == up) & (found[going] - below[going] > 1)]
        step *= 2
    going = np.flatnonzero(found - below > 1)
    while len(going):
        middle = (below[going] + found[going]) >> 1
        less = hay[middle] < keys[going]
        below[going[less]], found[going[~less]] = middle[less], middle[~less]
        going = going[found[going] - below[going] > 1]
    return found


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[0], starts[0] + 1, ...`` (``sizes[0]`` numbers), then the same of the next."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Tokens(NamedTuple):
    """Token ids of several documents in a row, each token's end offset, and each document's number of tokens."""

    ids: np.ndarray
    ends: np.ndarray
    counts: np.ndarray


def tokens_of(lists: list[list[int]], sizes: np.ndarray) -> Tokens:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter((i for some in lists for i in some), np.int64, int(counts.sum()))
    return Tokens(ids, np.cumsum(sizes[ids]), counts)


def _driven(driver: Tokens, other: Tokens, docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links of ``docs``: places of both tokens; and the places, in either list, of ends that both have."""
    own_first, other_first = (np.cumsum(t.counts) - t.counts for t in (driver, other))
    n, m = driver.counts[docs], other.counts[docs]
    at, rank = _runs(own_first[docs], n), _runs(np.zeros_like(n), n)
    low = np.repeat(other_first[docs], n)
    start = low + (rank + 1) * np.repeat(m, n) // np.repeat(n, n) - 1  # where it would be if both lists ran evenly
    place = gallop(driver.ends[at], other.ends, low, low + np.repeat(m, n), np.maximum(start, low))
    common = other.ends[place] == driver.ends[at]
    # A token begins where the one before it ended: at the rank found for that end.
    first = np.where(rank == 0, low, np.roll(place + common, 1))
    links = place - first + 1
    return np.repeat(at, links), _runs(first, links), at[common], place[common]


class Aligned(NamedTuple):
    """Places of the linked tokens, a before b in documents' order, and which tokens of a and b end a group."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray


def align(a: Tokens, b: Tokens) -> Aligned:
    """Links and groups of documents that have tokens in both lists; in each, the shorter list drives."""
    short = a.counts <= b.counts
    a1, b1, ends1, other1 = _driven(a, b, np.flatnonzero(short))
    b2, a2, ends2, other2 = _driven(b, a, np.flatnonzero(~short))
    a_ends, b_ends = np.zeros(len(a.ids), bool), np.zeros(len(b.ids), bool)
    a_ends[ends1] = a_ends[other2] = b_ends[other1] = b_ends[ends2] = True
    return Aligned(np.concatenate([a1, a2]), np.concatenate([b1, b2]), a_ends, b_ends)


def _group_texts(a: Tokens, b: Tokens, found: Aligned, words: list[str], a_size: int, b_size: int) -> list[str]:
    """Each document's groups as ``a1,a2|b1;a3|b2,b3``. ``words``: ids of a with a comma, a bar, of b with a comma, a semicolon."""
    # A token's place in the text: its own rank, and the other side's tokens in the groups before it (b: and its own group).
    a_group, b_group = (np.cumsum(ends) - ends for ends in (found.a_ends, found.b_ends))
    a_before = np.concatenate([[0], np.cumsum(np.bincount(a_group))])
    b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group))])
    order = np.empty(len(a.ids) + len(b.ids), np.int64)
    order[np.arange(len(a.ids)) + b_before[a_group]] = a.ids + a_size * found.a_ends
    order[np.arange(len(b.ids)) + a_before[b_group + 1]] = 2 * a_size + b.ids + b_size * found.b_ends
    edges = np.concatenate([[0], np.cumsum(a.counts + b.counts)]).tolist()
    said = list(map(words.__getitem__, order.tolist()))
    return ["".join(said[i:j])[:-1] for i, j in zip(edges, edges[1:])]


class Aligner:
    """Aligns portions of texts; made once in a Python worker."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None):
        self.a, self.b = byte_level(a_path, a_ranks), pieces(b_path)
        self.words = [f"{i}{sign}" for size, signs in ((self.a.size, ",|"), (self.b.size, ",;")) for sign in signs
                      for i in range(size)]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, Tokens, Tokens]:
        """Which texts have tokens: those whose tokens of either kind spell a blank and the text. And these tokens."""
        kept = np.array([bool(t) for t in texts], bool)
        lists = [[], []]
        some = np.flatnonzero(kept)
        if len(some):
            spelt = [" " + texts[i] for i in some]
            lists = [self.a.encode(spelt), self.b.encode([texts[i] for i in some])]
            want = [t.encode() for t in spelt]
            for own, tokens in zip((self.a, self.b), lists):
                counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
                ids = np.fromiter((i for t in tokens for i in t), np.int64, int(counts.sum()))
                if own.bytes.join(ids) == b"".join(want) and np.array_equal(
                        np.diff(np.concatenate([[0], np.cumsum(own.bytes.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])]),
                        [len(w) for w in want]):
                    continue
                for i, (t, w) in enumerate(zip(tokens, want)):
                    kept[some[i]] &= own.bytes.join(np.array(t, np.int64)) == w
        lists = [[t for t, i in zip(tokens, some) if kept[i]] for tokens in lists]
        return kept, tokens_of(lists[0], self.a.bytes.sizes), tokens_of(lists[1], self.b.bytes.sizes)


_ALIGNERS: dict[tuple, Aligner] = {}


def _aligner(*paths) -> Aligner:
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _portion(aligner: Aligner, texts: list[str]) -> tuple[dict, tuple]:
    """Numbers and digests of each text, with its distinct pairs as places in the portion's list; and that list."""
    kept, a, b = aligner(texts)
    found, docs = align(a, b), int(kept.sum())
    doc = np.repeat(np.arange(docs), a.counts)[found.a]
    pairs, slot = np.unique(a.ids[found.a] << 32 | b.ids[found.b], return_inverse=True)
    held, times = np.unique(doc * max(len(pairs), 1) + slot, return_counts=True)
    of_doc, slots = held // max(len(pairs), 1), held % max(len(pairs), 1)
    edges = np.searchsorted(of_doc, np.arange(docs + 1))
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in _group_texts(a, b, found, aligner.words, aligner.a.size, aligner.b.size)]
    counts = {"n_a": a.counts, "n_b": b.counts, "n_links": np.bincount(doc, minlength=docs),
              "n_groups": np.bincount(np.repeat(np.arange(docs), a.counts)[found.a_ends], minlength=docs)}
    rows = {name: np.zeros(len(texts), np.int64) for name in counts}
    for name, values in counts.items():
        rows[name][kept] = values
    at = np.cumsum(kept) - 1
    rows["groups_sha256"] = [digests[i] if k else "" for k, i in zip(kept, at)]
    sizes = np.where(kept, np.diff(edges)[at] if docs else 0, 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    for name, values in (("slots", slots), ("times", times)):
        rows[name] = pa.ListArray.from_arrays(offsets, pa.array(values, pa.int32()))
    return rows, (pairs >> 32, pairs & 0xFFFFFFFF, np.bincount(slots, minlength=len(pairs)))


_NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def link_portions(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Documents' own numbers and, once in each portion (``portion``), its distinct pairs ``a, b`` and their documents.

    A document's ``slots`` are places in its portion's list, ``times`` how often it links each.
    """
    source = id_and_text(docs, id_col, text_col)
    key = source.schema["id"].dataType.simpleString()
    schema = (f"portion long, doc_id {key}, {', '.join(f'{n} long' for n in _NUMBERS)}, groups_sha256 string, "
              "slots array<int>, times array<int>, pairs struct<a:array<int>,b:array<int>,docs:array<int>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, number = _aligner(a_path, b_path, a_ranks), TaskContext.get().partitionId() << 32
        for batch in portions(batches, most=PORTION):
            if not batch.num_rows:
                continue
            rows, pairs = _portion(aligner, texts_of(batch))
            # The portion's list stands in its first row.
            listed = pa.array([dict(zip(("a", "b", "docs"), pairs))] + [None] * (batch.num_rows - 1), pa.struct(
                [(n, pa.list_(pa.int32())) for n in ("a", "b", "docs")]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(batch.num_rows, number)), batch.column(0), *[pa.array(rows[n]) for n in _NUMBERS],
                 pa.array(rows["groups_sha256"], pa.string()), rows["slots"], rows["times"], listed],
                names=["portion", "doc_id", *_NUMBERS, "groups_sha256", "slots", "times", "pairs"])
            number += 1

    return source.mapInArrow(run, schema)


def pair_counts(linked: DataFrame) -> DataFrame:
    """``a, b, n, best``: in how many documents each pair of ids is linked, and whether no other pair of its ``a`` has more."""
    counts = staged(linked.filter("pairs IS NOT NULL").select(F.inline(F.arrays_zip("pairs.a", "pairs.b", "pairs.docs"))).groupBy(
        "a", "b").agg(F.sum(F.col("docs").cast("long")).alias("n")), "pairs")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(docs: DataFrame, a_path: str, b_path: str, a_ranks: str | None = None, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row.

    ``n_best`` counts links whose pair stands in as many documents as any of its a id, ``count_sum`` adds up the links'
    numbers of documents. Null and empty texts, and texts that their tokens do not spell, have no tokens: zeros and an empty
    digest. Each row is a document, also where ids or texts repeat; an empty table gives no rows; extra columns are
    ignored. Tokenizations are stored once; the shuffles move portions' distinct pairs and documents' places in them.
    """
    linked = staged(link_portions(docs, a_path, b_path, a_ranks, id_col, text_col), "links")
    listed = linked.filter("pairs IS NOT NULL").select(
        "portion", F.posexplode(F.arrays_zip("pairs.a", "pairs.b")).alias("slot", "pair")).select("portion", "slot", "pair.a", "pair.b")
    # As many rows as a portion has distinct pairs: bounded by its text.
    known = listed.join(pair_counts(linked), ["a", "b"]).groupBy("portion").agg(
        F.array_sort(F.collect_list(F.struct("slot", "n", "best"))).alias("known")).select(
        F.col("portion").alias("of"), "known.n", "known.best")
    key = linked.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {key}, {', '.join(f'{n} long' for n in _NUMBERS)}, n_best long, count_sum long, groups_sha256 string"

    def look_up(mine: pa.Table, listed: pa.Table) -> pa.Table:
        slots = mine.column("slots").combine_chunks()
        sizes = np.diff(slots.offsets.to_numpy())
        places, times = (mine.column(c).combine_chunks().flatten().to_numpy() for c in ("slots", "times"))
        n, best = np.zeros(0, np.int64), np.zeros(0, bool)
        if listed.num_rows:
            n = listed.column("n").combine_chunks().flatten().to_numpy()
            best = listed.column("best").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        totals = []
        for values in (best[places] * times.astype(np.int64), n[places] * times):
            before = np.concatenate([[0], np.cumsum(values)])
            at = np.concatenate([[0], np.cumsum(sizes)])
            totals.append(pa.array(before[at[1:]] - before[at[:-1]], pa.int64()))
        return pa.table([mine.column("doc_id"), *[mine.column(c) for c in _NUMBERS], *totals, mine.column("groups_sha256")],
                        names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])

    return linked.drop("pairs").groupBy("portion").cogroup(known.groupBy("of")).applyInArrow(look_up, schema)
