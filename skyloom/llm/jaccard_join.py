"""Jaccard self-join of documents on word n-grams, heavy and light sets apart, and its connected components.

Two sets of n and m shingles link when they share ``need(n, m)`` of them. Equal sets are one node from the start.

* Light sets (few shingles) enumerate all their subsets of the size that a link takes, for each partner size. Sets that
  share such a subset are linked, so all holders of a subset form one star: no pair is ever looked at.
* Heavy sets go through inverted lists. Under any fixed order of shingles, linked sets share one among each
  one's first ``prefix`` shingles, so only these are listed. The order puts very frequent shingles last (they are
  known by counting all documents) and is random otherwise.

The boundary is where the number of subsets passes the cost of scanning lists. Sets just below it are in both,
as partners of heavy ones.

Lists that have the same first node are worked on together. Such a group is cut into blocks of bounded size, and each pair of
blocks is one unit of work: first the listed shingles alone say which sets can still link, and for these the
whole sets are fetched and compared. Units give a spanning forest of their links, never all pairs. Within a group
of many blocks, each is compared with itself and the first one; further pairs of blocks are left out where
all their sets are already known to be connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import id_and_text, let_go, portions, staged, texts_of
from skyloom.llm.components import components
from skyloom.llm.shingles import Shingled, mix, set_digests, shingle

#: Shingles listed by more than so many documents come last in the order, at most HEAVY_KEPT of them (the most frequent).
#: Which ones they are changes the work and not the result.
HEAVY_LIST, HEAVY_KEPT = 64, 100_000
#: Bits of the filter that leaves out shingles of one document only. A fuller filter leaves out fewer.
FILTER_BITS = 1 << 25
#: Most sets, and most shingles, in one block.
BLOCK_SETS, BLOCK_SHINGLES = 512, 1_000_000
#: No set of more shingles is light, whatever the costs.
LIGHT_MOST = 32
#: Rows without an id get a number from here on, made from their text.
NO_ID = 1 << 62


def need(n, m, percent: int):
    """Shared shingles that link sets of n and m: the least x with 100 x >= percent (n + m - x)."""
    return -(-percent * (n + m) // (100 + percent))


def prefix(n, percent: int):
    """Shingles to list of a set of n: more than a partner may lack."""
    return n - -(-percent * n // 100) + 1


def subset_keys(n: int, boundary: int, percent: int) -> list[tuple[int, int, int]]:
    """(smaller size, larger size, subset size) for each size of partner that a light set of n can have."""
    sizes = range(-(-percent * n // 100), min(boundary, 100 * n // percent) + 1)
    return [(min(n, m), max(n, m), need(n, m, percent)) for m in sizes]


def light_boundary(mean_list: float, percent: int) -> int:
    """The largest size up to which enumerating subsets costs no more than scanning lists.

    A list entry costs itself, and for each set met there one comparison that walks both sets.
    """
    boundary = 0
    for n in range(1, LIGHT_MOST + 1):
        subsets = sum(math.comb(n, size) for _, _, size in subset_keys(n, 100 * n // percent, percent))
        if subsets > prefix(n, percent) * (1 + mean_list * 2 * n):
            break
        boundary = n
    return boundary


def _key(doc_id: Column, text: Column) -> Column:
    made = F.xxhash64(text).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)
    return F.coalesce(doc_id.cast("long"), made)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    source = id_and_text(docs, id_col, text_col)
    return source.select(_key(F.col("id"), F.col("text")).alias("key"), "text")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                                    pa.array(values.view(np.int64)))


def _head(shingled: Shingled, lengths: np.ndarray) -> np.ndarray:
    """The first ``lengths[i]`` shingles of each set."""
    begin = np.cumsum(shingled.sizes) - shingled.sizes
    lengths = np.minimum(lengths, shingled.sizes)
    return shingled.values[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]


def counted(n, percent: int):
    """How many of a set's smallest shingles are counted: one and a half prefixes."""
    return np.minimum(n, prefix(n, percent) * 3 // 2)


class Frequencies(NamedTuple):
    """``last``: shingles to put last; ``shared``: bits of those that several documents have; ``mean_list``: how
    many other documents are in the list of a shingle that is not put last, on average over entries."""

    last: np.ndarray
    shared: np.ndarray
    mean_list: float


def _bit(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at = values & np.uint64(bits - 1)
    return (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)


def _lots(batches: Iterable[pa.RecordBatch], text_at: int = 1) -> Iterator[pa.RecordBatch]:
    """``portions`` to make shingles of, in a worker that holds nothing else."""
    let_go()
    return portions(batches, text_at)


def frequencies(keyed: DataFrame, words: int, percent: int) -> Frequencies:
    """Counts over the smallest shingles (see ``counted``) of all documents, reduced to what the lists need."""

    def heads(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, 0):
            sets = shingle(texts_of(batch), words)
            values = _head(sets, counted(sets.sizes, percent))
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["token"])

    counts = keyed.select("text").mapInArrow(heads, "token long").groupBy("token").count().filter("count > 1")
    counts = staged(counts, "counts")
    heavy = counts.filter(F.col("count") > HEAVY_LIST).orderBy(F.desc("count"), "token").limit(HEAVY_KEPT)
    tokens = np.array(sorted(r["token"] for r in heavy.select("token").collect()), np.int64).view(np.uint64)
    rest = counts.filter(F.col("count") <= HEAVY_LIST).agg(
        F.sum(F.col("count") * (F.col("count") - 1)).alias("met"), F.sum("count").alias("entries")).first()
    words_of_bits = counts.groupBy(F.expr(f"(token & {FILTER_BITS - 1}) >> 6").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, int(token & 63)))").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    shared = np.zeros(FILTER_BITS // 64, np.int64)
    shared[words_of_bits["word"].to_numpy()] = words_of_bits["bits"].to_numpy()
    return Frequencies(np.sort(tokens), shared.view(np.uint64), (rest["met"] or 0) / max(rest["entries"] or 0, 1))


def _order(sets: Shingled, last: np.ndarray) -> tuple[np.ndarray | slice, np.ndarray]:
    """The order to list shingles in (those in ``last`` at the end of their set), and the place of each in its sorted set."""
    of = np.repeat(np.arange(len(sets.sizes)), sets.sizes)
    rank = np.arange(len(of)) - (np.cumsum(sets.sizes) - sets.sizes)[of]
    if not len(last) or not len(of):
        return slice(None), rank
    late = last[np.minimum(np.searchsorted(last, sets.values), len(last) - 1)] == sets.values
    return np.argsort(2 * of + late, kind="stable") if late.any() else slice(None), rank


def with_uncounted(keyed: DataFrame, words: int, percent: int, known: Frequencies) -> Frequencies:
    """``known`` with the bits of all shingles that a set lists without having counted them.

    Moving frequent shingles to the end lets a set list others beyond its counted ones. One that another set did
    count may have the count 1 and still be in both lists, so it must not pass for a shingle of one document.
    """
    if not len(known.last):
        return known
    shared = keyed.sparkSession.sparkContext.broadcast(known.last)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 64, np.uint64)
        for batch in _lots(batches, 0):
            sets = shingle(texts_of(batch), words)
            order, rank = _order(sets, shared.value)
            lengths = np.minimum(prefix(sets.sizes, percent), sets.sizes)
            uncounted = rank >= np.repeat(counted(sets.sizes, percent), sets.sizes)
            beyond = _head(Shingled(uncounted[order], sets.sizes), lengths)
            word, bit = _bit(_head(Shingled(sets.values[order], sets.sizes), lengths)[beyond], FILTER_BITS)
            np.bitwise_or.at(bits, word, np.uint64(1) << bit)
        filled = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(bits[filled].view(np.int64))], names=["word", "bits"])

    more = keyed.select("text").mapInArrow(run, "word long, bits long").groupBy("word").agg(
        F.bit_or("bits").alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    bits = known.shared.copy()
    bits[more["word"].to_numpy()] |= more["bits"].to_numpy().view(np.uint64)
    return known._replace(shared=bits)


def sketches(keyed: DataFrame, words: int, percent: int, boundary: int, known: Frequencies) -> DataFrame:
    """``key, n, d1, d2`` (two digests of the set), ``tokens`` to list and ``subsets`` of each document.

    A shingle that was counted and is in no other document's list is left out: its list would have one entry.
    """
    shared = keyed.sparkSession.sparkContext.broadcast(known)
    least_heavy = -(-percent * (boundary + 1) // 100)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, several = shared.value.last, shared.value.shared
        for batch in _lots(batches):
            sets = shingle(texts_of(batch), words)
            d1, d2 = set_digests(sets)
            begin = np.cumsum(sets.sizes) - sets.sizes
            order, rank = _order(sets, last)
            lengths = np.where(sets.sizes >= max(least_heavy, 1), np.minimum(prefix(sets.sizes, percent), sets.sizes), 0)
            word, bit = _bit(sets.values, 64 * len(several))
            alone = (rank < np.repeat(counted(sets.sizes, percent), sets.sizes)) & ((several[word] >> bit) & np.uint64(1) == 0)
            tokens = _head(Shingled(sets.values[order], sets.sizes), lengths)
            listed = ~_head(Shingled(alone[order], sets.sizes), lengths)
            lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[listed], minlength=len(lengths))
            tokens = tokens[listed]
            keys, counts = [], np.zeros(len(sets.sizes), np.int64)
            for i in np.flatnonzero((sets.sizes > 0) & (sets.sizes <= boundary)):
                own = _subset_hashes(sets.values[begin[i]:begin[i] + sets.sizes[i]], boundary, percent)
                keys.append(own)
                counts[i] = len(own)
            keys = np.concatenate(keys) if keys else np.zeros((0, 3), np.int64)
            subsets = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(keys[:, 2] == 1)],
                                           names=["k1", "k2", "even"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets.sizes), pa.array(d1), pa.array(d2),
                 _lists(tokens, lengths), subsets],
                names=["key", "n", "d1", "d2", "tokens", "subsets"])

    return keyed.mapInArrow(run, "key long, n long, d1 long, d2 long, tokens array<long>, "
                                 "subsets array<struct<k1:long,k2:long,even:boolean>>")


def _subset_hashes(values: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Rows (two hashes of sizes and subset, 1 where both sizes are equal) for each subset that a partner may share."""
    found = []
    first, second = mix(values), mix(values ^ np.uint64(0x5DEECE66D))
    for low, high, size in subset_keys(len(values), boundary, percent):
        left_out = np.array(list(combinations(range(len(values)), len(values) - size)), np.int64)
        left_out = left_out.reshape(math.comb(len(values), size), len(values) - size)
        salt = np.uint64(low * 1_000_003 + high)
        k1 = mix(first.sum() - first[left_out].sum(axis=1, dtype=np.uint64) + salt)
        k2 = mix(second.sum() - second[left_out].sum(axis=1, dtype=np.uint64) + salt)
        found.append(np.stack([k1.view(np.int64), k2.view(np.int64), np.full(len(k1), low == high, np.int64)], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


DIGESTS = ["n", "d1", "d2"]


def light_edges(sketch: DataFrame) -> DataFrame:
    """Stars over the holders of each subset. Where two sizes are asked for, both must be there."""
    held = sketch.filter(F.size("subsets") > 0).groupBy(*DIGESTS).agg(
        F.min("key").alias("node"), F.first("subsets").alias("subsets"))
    held = held.select("node", "n", F.explode("subsets").alias("s")).select("node", "n", "s.*")
    hubs = held.groupBy("k1", "k2", "even").agg(
        F.min("node").alias("hub"), F.max("node").alias("most"), F.min("n").alias("low"), F.max("n").alias("high"))
    hubs = hubs.filter("hub < most AND (even OR low < high)").select("k1", "k2", "hub")
    return held.join(hubs, ["k1", "k2"]).filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))


def _runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[dict]:
    """Column name -> numpy array (lists: an Arrow array) of each run of equal ``keys`` in sorted batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        table = pa.Table.from_batches(held).combine_chunks()
        if not table.num_rows:
            held = []
            continue
        changed = np.zeros(table.num_rows, bool)
        for key in keys:
            column = table[key].to_numpy()
            changed[1:] |= column[1:] != column[:-1]
        edges = np.flatnonzero(changed)
        last = int(edges[-1]) if len(edges) else 0
        if last:
            yield from _cut(table.slice(0, last), [0, *edges.tolist()])
        held = table.slice(last).combine_chunks().to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield from _cut(table, [0, table.num_rows])


def _cut(table: pa.Table, edges: list[int]) -> Iterator[dict]:
    columns = {}
    for name in table.column_names:
        column = table[name].chunk(0)
        columns[name] = column if pa.types.is_list(column.type) else column.to_numpy(zero_copy_only=False)
    for a, b in zip(edges, edges[1:]):
        yield {name: column[a:b] for name, column in columns.items()}


def _shared_counts(rows: np.ndarray, tokens: np.ndarray, count: int) -> np.ndarray:
    """How many tokens each two of ``count`` sets share, from (set, token) entries without repeats."""
    _, column, often = np.unique(tokens, return_inverse=True, return_counts=True)
    keep = often[column] > 1
    rows, column = rows[keep], column[keep]
    shared = np.zeros((count, count), np.float32)
    if not len(rows):
        return shared
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    width = max(1, min(int(column[-1]) + 1, 4_000_000 // count))
    for at in range(0, int(column[-1]) + 1, width):
        a, b = np.searchsorted(column, [at, at + width])
        holds = np.zeros((count, width), np.float32)
        holds[rows[a:b], column[a:b] - at] = 1
        shared += holds @ holds.T
    return shared


def _work_pairs(count: int, first: np.ndarray) -> np.ndarray:
    """Which pairs of sets a unit looks at: all within one block, or those across two."""
    return np.triu(np.ones((count, count), bool), 1) if first.all() else first[:, None] & ~first[None, :]


def _can_link(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """The sets of each unit that can still link with another of it, judged by the shingles listed.

    Linked sets share at least ``least`` listed shingles. Those of this group are counted; what they may share in other
    groups is at most what either has listed there. In one group at least they share their part of ``least``, so
    groups in which they share less can leave the two to another.
    """
    out = [[], [], [], [], []]

    def batch() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out],
                                          names=["pivot", "i", "j", "node", "block"])
        for c in out:
            c.clear()
        return done

    for run in _runs(batches, ["pivot", "i", "j"]):
        nodes, at, row = np.unique(run["node"], return_index=True, return_inverse=True)
        if len(nodes) < 2:
            continue
        n, listed, first = run["n"][at], run["listed"][at], run["block"][at] == run["i"][0]
        shared = _shared_counts(row, run["token"], len(nodes))
        outside = listed - np.bincount(row, minlength=len(nodes))
        share = need(n[:, None], n[None, :], percent)
        least = np.minimum((prefix(n, percent) - n)[:, None], (prefix(n, percent) - n)[None, :]) + share
        groups = np.minimum(run["groups"][at][:, None], run["groups"][at][None, :])
        fits = (shared * groups >= least) & (shared + np.minimum(outside[:, None], outside[None, :]) >= least) & (
            share <= np.minimum(n[:, None], n[None, :])) & _work_pairs(len(nodes), first)
        both = fits.any(axis=0) | fits.any(axis=1)
        if both.any():
            for c, value in zip(out, (run["pivot"][0], run["i"][0], run["j"][0], nodes[both], run["block"][at][both])):
                c.append(np.broadcast_to(np.asarray(value, np.int64), int(both.sum())))
            if len(out[0]) > 5000:
                yield batch()
    if out[0]:
        yield batch()


def _forest(links: np.ndarray, components: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what was not yet connected."""
    root = components.copy()
    kept = []
    for a, b in np.argwhere(links):
        if root[a] != root[b]:
            kept.append((int(a), int(b)))
            root[root == root[b]] = root[a]
    return kept


def _link(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links within each unit, by comparing whole sets."""
    for run in _runs(batches, ["pivot", "i", "j"]):
        count = len(run["node"])
        if count < 2:
            continue
        sets = run["tokens"]
        n = run["n"]
        rows = np.repeat(np.arange(count), n)
        shared = _shared_counts(rows, sets.flatten().to_numpy(), count)
        union = n[:, None] + n[None, :] - shared
        links = (100 * shared.astype(np.float64) >= percent * union) & _work_pairs(count, run["block"] == run["i"][0])
        edges = _forest(links, np.arange(count))
        if edges:
            a, b = np.array(edges).T
            yield pa.RecordBatch.from_arrays([pa.array(run["node"][a]), pa.array(run["node"][b])], names=["a", "b"])


def _units(members: DataFrame, first_round: bool) -> DataFrame:
    """Each member of a group once for every unit (pair of blocks ``i <= j``) that it is in, of one round."""
    own, all_blocks = F.col("block"), F.sequence(F.lit(0), F.col("blocks") - 1)
    if first_round:
        partners = F.array_distinct(F.when(own == 0, all_blocks).otherwise(F.array(F.lit(0), own)))
    else:
        partners = F.filter(all_blocks, lambda k: (k > 0) & (k != own))
        members = members.filter("block > 0 AND blocks > 2")
    return members.withColumn("with", F.explode(partners)).withColumn("i", F.least("block", "with")).withColumn(
        "j", F.greatest("block", "with")).drop("with")


def heavy_edges(keyed: DataFrame, sketch: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between heavy sets (a spanning part of them), from inverted lists."""
    by_token = Window.partitionBy("token")
    nodes = sketch.filter(F.size("tokens") > 0).groupBy(*DIGESTS).agg(
        F.min("key").alias("node"), F.first("tokens").alias("tokens"))
    entries = nodes.select("node", F.explode("tokens").alias("token"))
    lists = staged(entries.withColumn("holders", F.count(F.lit(1)).over(by_token)).withColumn(
        "pivot", F.min_by("node", F.xxhash64("node")).over(by_token)).filter("holders > 1").drop("holders"), "lists")
    members = lists.groupBy("pivot", "node").agg(F.count(F.lit(1)).alias("listed"))
    totals = members.groupBy("node").agg(F.sum("listed").alias("listed"), F.count(F.lit(1)).alias("groups"))
    sizes = sketch.groupBy(*DIGESTS).agg(F.min("key").alias("node"))
    members = staged(members.select("pivot", "node").join(totals, "node").join(sizes, "node"), "members")
    blocks = members.groupBy("pivot").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = members.join(blocks, "pivot").withColumn(
        "block", F.pmod(F.xxhash64("node", "pivot"), F.col("blocks")).cast("int"))
    unit = ["pivot", "i", "j"]

    def compare(units: DataFrame) -> DataFrame:
        """Edges of ``units``: a row for each of their members."""
        units = units.select(*unit, "node", "block", *DIGESTS, "listed", "groups")
        able = units.join(lists, ["pivot", "node"]).repartition(*unit).sortWithinPartitions(*unit).select(
            *unit, "node", "n", "listed", "groups", "block", "token").mapInArrow(
            lambda batches: _can_link(batches, percent), "pivot long, i long, j long, node long, block long")
        able = able.groupBy("node").agg(F.collect_list(F.struct(*unit, "block")).alias("units"))
        wanted = staged(able.join(units.select("node", *DIGESTS).distinct(), "node"), "wanted")
        sets = whole_sets(keyed, wanted, words).select("node", "n", "tokens", F.explode("units").alias("u")).select(
            "u.*", "node", "n", "tokens")
        return staged(sets.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(
            lambda batches: _link(batches, percent), "a long, b long"), "edges")

    found = compare(_units(members, True))
    if members.filter("blocks > 2").isEmpty():
        return found
    # Groups of many blocks: the other pairs of blocks, but for those that are connected throughout.
    placed = members.filter("blocks > 2").join(components(found), "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    units = _units(placed, False)
    unconnected = units.groupBy(*unit).agg(
        F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select(*unit)
    return found.unionByName(compare(units.join(unconnected, unit)))


def whole_sets(keyed: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``wanted`` (``node``, digests, ``units``) with ``tokens``: all shingles, made anew from the node's text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _lots(batches, 5):
            sets = shingle(texts_of(batch), words)
            d1, d2 = set_digests(sets)
            # One id can have several texts; the node stands for the set with its digests.
            own = pa.array((batch["n"].to_numpy() == sets.sizes) & (batch["d1"].to_numpy() == d1) & (batch["d2"].to_numpy() == d2))
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["n"], batch["units"], _lists(sets.values, sets.sizes)],
                names=["node", "n", "units", "tokens"]).filter(own)

    # The join deals texts out by key, so leaving out repeated rows needs no further shuffle.
    # It is a shuffled join at every size, as the wanted nodes grow with the input.
    texts = keyed.withColumnRenamed("key", "node").join(wanted.select("node").hint("merge"), "node", "left_semi").groupBy(
        "node", "text").agg(F.count(F.lit(1)).alias("rows"))
    return texts.join(wanted, "node").select("node", "n", "d1", "d2", "units", "text").mapInArrow(
        run, "node long, n long, units array<struct<pivot:long,i:long,j:long,block:long>>, tokens array<long>")


def _components(keyed: DataFrame, words: int, percent: int) -> DataFrame:
    """``key, n, component`` of each row; a component is the smallest key in it."""
    known = with_uncounted(keyed, words, percent, frequencies(keyed, words, percent))
    sketch = staged(sketches(keyed, words, percent, light_boundary(known.mean_list, percent), known), "sketch")
    edges = light_edges(sketch).unionByName(heavy_edges(keyed, sketch, words, percent))
    nodes = sketch.filter("n > 0").groupBy(*DIGESTS).agg(F.min("key").alias("node"))
    placed = nodes.join(components(edges), "node", "left").select(*DIGESTS, F.coalesce("component", "node").alias("component"))
    return sketch.select("key", *DIGESTS).join(placed, DIGESTS, "left").select(
        "key", "n", F.coalesce("component", "key").alias("component"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                       percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row.

    ``component_id`` is the smallest id that links lead to, the row's own included; links are between sets of distinct
    ``words``-word shingles with 100 * shared >= percent * union. Null and empty texts, and texts
    without words, have no shingles and link with nothing: their component is their own id. Rows without an id
    link like others and get the smallest id of what they link with, or null. Repeated rows stay, each with the
    same result. Ids are whole numbers. An empty table gives no rows; extra columns are ignored.
    """
    rows = _components(_keyed(docs, id_col, text_col), words, percent)
    real = lambda column: F.when(F.col(column) < NO_ID, F.col(column)).alias(column)
    return rows.select(real("key"), "n", real("component")).toDF("doc_id", "n_shingles", "component_id")


def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4,
                          percent: int = 85) -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, with all their columns.

    Rows without an id stay only where no row with one is linked to them. Rows with one id stay or go together.
    """
    rows = _components(_keyed(docs, id_col, text_col), words, percent)
    kept = rows.filter("key = component").select("key").distinct()
    with_key = docs.select(_key(docs[id_col], F.coalesce(docs[text_col], F.lit(""))).alias("key"),
                           F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    return with_key.join(kept, "key", "left_semi").select("row.*")
