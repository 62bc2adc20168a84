"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is planned on their histogram, whose size the capacity
bounds: pieces longer than a third of the capacity are matched in pairs, largest first, each with the
longest one that still fits; shorter pieces go, longest first, into the tightest gap that takes them. The plan is a
list of slots, each for a run of pieces of one length and a run of sequences. Pieces get their rank within their
length in Spark and look up their slot, so no piece passes through the driver.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import id_and_text, kept, partitions, portions, staged, texts_of

CAPACITY = 4096
END_ID = 1
#: Encoded words that a Python worker keeps in each of two generations, some 200 bytes each.
CACHED_WORDS = 300_000
#: Small letters that no normalisation changes, and the ASCII marks after them. Special tokens end in ``>``, which is none of these.
_PLAIN = re.compile(rb"((?:[a-z]++|\xc3[\x9f-\xb6\xb8-\xbf])++)([!-/:;=?@\[-`{-~]*+)").fullmatch
#: Tokenizers whose first steps do nothing to plain words but to part the letters from the marks.
_NORMALIZERS = {"NFC", "Replace", "Lowercase"}
_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordIds:
    """Ids of whole texts, from ids of their words.

    For tokenizers that drop white space and never join across it, a text's ids are its words' ids one after
    the other. Distinct words are encoded by the library once and kept, packed as little-endian 32-bit numbers.
    With ``fold`` (tokenizers that lower-case) A-Z are lower-cased first, unless the text could hold a special token.
    Where the tokenizer parts letters from marks, a plain word's letters and marks are encoded apart, so that words are new
    less often, and many letters at a time by the library's model without the steps that do nothing to them.
    """

    def __init__(self, path: str, fold: bool = True, limit: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.plain = self._plain(path)
        # What is looked up moves to the young generation, so frequent words are never lost.
        self.fold, self.limit, self.known, self.old = fold, limit, {}, {}

    def _plain(self, path: str):
        """The encoder of plain letters; None if the tokenizer does more to them, or no suffix tells where a word ends."""
        spec = json.loads(self.tokenizer.to_str())
        steps, cut = [(spec[k] or {}) for k in ("normalizer", "pre_tokenizer")]
        first, second = [*cut.get("pretokenizers", []), {}, {}][:2]
        suffix = spec["model"].get("end_of_word_suffix")
        if not (suffix and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
                and all(s["type"] in _NORMALIZERS and s.get("pattern") in (None, {"Regex": r"\s+"}) for s in steps.get("normalizers", [{"type": ""}]))
                and first.get("pattern") == {"Regex": _LETTERS} and (first["behavior"], first["invert"]) == ("Removed", True)
                and second.get("type") == "ByteLevel" and not second["add_prefix_space"] and not second["use_regex"]
                and len(cut["pretokenizers"]) == 2):
            return None
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        plain = Tokenizer.from_file(path)
        plain.no_truncation()
        plain.no_padding()
        plain.normalizer = normalizers.Sequence([])
        plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return plain

    def _learn(self, words: list[bytes]) -> None:
        """Encode ``words``, none of which is known, and keep them."""
        known, old, letters, others, parted = self.known, self.old, {}, {}, []
        for word in words:
            if word in old:
                known[word] = old[word]
            elif not self.plain or not (match := _PLAIN(word)):
                others[word] = None
            else:
                core, marks = match.groups()
                if marks:
                    parted.append((word, core, marks))
                for part, new in ((core, letters), (marks, others)):
                    if part and part not in known:
                        if part in old:
                            known[part] = old[part]
                        else:
                            new[part] = None
        letters, others = [*letters], [*others]
        for at in range(0, len(letters), 200):
            some = letters[at:at + 200]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4")
            ends, packed = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), ids.tobytes()
            known.update(zip(some, (packed[a:b] for a, b in zip([0, *ends], ends)), strict=True))
        for at in range(0, len(others), 10_000):
            some = others[at:at + 10_000]
            for word, code in zip(some, self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)):
                known[word] = np.array(code.ids, "<u4").tobytes()
        for word, core, marks in parted:
            known[word] = known[core] + known[marks]

    def pack(self, texts: list[str]) -> Iterator[bytes]:
        column = pa.array(texts, pa.large_string())
        if self.fold:
            column = pc.if_else(pc.match_substring(column, "<|"), column, pc.ascii_lower(column))
        split = pc.ascii_split_whitespace(column)
        words = split.values.dictionary_encode()
        distinct = words.dictionary.cast(pa.large_binary()).to_pylist()
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known, self.old, new = {}, self.known, distinct
        self._learn(new)
        packed, index, ends = [*map(self.known.__getitem__, distinct)], words.indices.to_numpy(), split.offsets.to_pylist()
        for start, end in zip(ends, ends[1:]):
            yield b"".join(map(packed.__getitem__, index[start:end].tolist()))


def _encoder(path: str) -> WordIds:
    return kept(("packing", path), lambda: WordIds(path))


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces: ``doc_id, piece, start, length, ids_crc32`` and, on request, ``ids``.

    A document is its ids and then ``end_id``; null and empty texts are that one id. Documents longer than the
    capacity are cut into pieces of it, the last of which may be shorter.
    """
    source = id_and_text(docs, id_col, text_col)
    fields = [T.StructField("doc_id", source.schema["id"].dataType), T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in portions(batches):
            ids = batch.column(0)
            rows, pieces, lengths, sums, lists = [], [], [], [], []
            for row, packed in enumerate(encoder.pack(texts_of(batch))):
                packed += end
                for piece, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at:at + 4 * capacity]
                    rows.append(row)
                    pieces.append(piece)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
                    if with_ids:
                        lists.append(np.frombuffer(part, "<u4").astype(np.int64))
            piece = np.array(pieces, np.int64)
            columns = [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(piece * capacity),
                       pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(cut, T.StructType(fields))


class Slot(NamedTuple):
    """Pieces ``first`` to ``last - 1`` of one length: ``per_bin`` to a sequence, from sequence ``base`` and ``at``."""

    length: int
    first: int
    last: int
    base: int
    at: int
    per_bin: int


def plan_slots(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slots for ``counts[length]`` pieces of each length.

    Sequences with equal gaps are handled as one run. A run that takes pieces of some length is left with a gap
    shorter than half of what it was, so there are O(capacity log capacity) slots however many pieces there are.
    """
    slots: list[Slot] = []
    placed: dict[int, int] = defaultdict(int)
    runs: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    gaps: list[int] = []
    opened = 0

    def put(length: int, bins: int, base: int, at: int, per_bin: int = 1, pieces: int | None = None) -> None:
        pieces = bins * per_bin if pieces is None else pieces
        slots.append(Slot(length, placed[length], placed[length] + pieces, base, at, per_bin))
        placed[length] += pieces

    def leave(gap: int, base: int, bins: int) -> None:
        if gap and bins:
            if not runs[gap]:
                insort(gaps, gap)
            runs[gap].append((base, bins))

    left = {length: n for length, n in counts.items() if n}
    large = sorted(length for length in left if 3 * length > capacity)
    # Large pieces: two of them at most fit together, the longest with the longest that fits.
    while large:
        longest = large[-1]
        fits = bisect_left(large, capacity - longest + 1) - 1
        partner = large[fits] if fits >= 0 else None
        if partner == longest and left[longest] == 1:
            partner = large[fits - 1] if fits else None
        bins = left[longest] if partner is None else left[longest] // 2 if partner == longest else min(
            left[longest], left[partner])
        put(longest, bins, opened, 0)
        left[longest] -= bins
        if partner is not None:
            put(partner, bins, opened, longest)
            left[partner] -= bins
        leave(capacity - longest - (partner or 0), opened, bins)
        opened += bins
        large = [length for length in large if left[length]]
    # Small pieces: into the tightest gap, which equal pieces then fill as far as they go.
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        rest = left[length]
        while rest:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                per_bin = capacity // length
                leave(capacity, opened, -(-rest // per_bin))
                opened += -(-rest // per_bin)
                continue
            gap = gaps[at]
            base, bins = runs[gap].pop()
            if not runs[gap]:
                gaps.pop(at)
            per_bin = gap // length
            full = min(bins, rest // per_bin)
            if full:
                put(length, full, base, capacity - gap, per_bin)
                leave(gap - per_bin * length, base, full)
                rest -= full * per_bin
            if rest and full < bins:  # the last sequence that this length reaches takes what is left
                put(length, 1, base + full, capacity - gap, per_bin, rest)
                leave(gap - rest * length, base + full, 1)
                full, rest = full + 1, 0
            leave(gap, base + full, bins - full)
    return slots


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (of ``token_pieces``) with ``sequence_id`` and ``offset``.

    Reads ``pieces`` twice, so give it a stored table. Pieces of one length are ranked in salted parts of which each
    holds about one shuffle partition's share, so a length that most pieces have is no hot key.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.createDataFrame(
        plan_slots(counts, capacity) or [Slot(0, 0, 0, 0, 0, 1)],
        "slot_length long, first long, last long, base long, at long, per_bin long")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(partitions(spark))))
    before = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)))
    ranked = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before.select("length", "salt", "before"), ["length", "salt"]).withColumn(
        "rank", F.col("rank") - 1 + F.coalesce("before", F.lit(0)))
    # The slots are bounded by the capacity, so sending them out is safe at any input size.
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first"))
                         & (F.col("rank") < F.col("last")))
    within = F.col("rank") - F.col("first")
    return placed.select(
        *pieces.columns, (F.col("base") + F.floor(within / F.col("per_bin"))).alias("sequence_id"),
        (F.col("at") + within % F.col("per_bin") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their places in the packed sequences.

    One row per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``. Null and empty
    texts are one end id each; repeated rows and null ids are packed like any others; an empty table gives no rows;
    further columns are ignored. Sequence ids count from 0, and each sequence is filled without gaps from 0.
    """
    return pack_pieces(staged(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids), "pieces"),
                       capacity)
