"""Word shingles of whole texts as 64-bit numbers, in numpy over whole batches."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np

#: Bytes handled at once, and the longest word that takes the vectorised way.
BLOCK, LONG_WORD = 1 << 18, 1 << 12

_U = np.uint64
_RANDOM = np.random.default_rng(20240501)
_OF_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
_POWERS = np.multiply.accumulate(np.concatenate([[_U(1)], np.full(LONG_WORD, _BASE, np.uint64)]))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all others."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in a block of bytes that begins and ends at white space."""
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    # Each byte's number times a power of the base by its place in its word, summed over the word.
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = _OF_BYTE[data[inside[1:-1]]] * _POWERS[np.minimum(place, LONG_WORD)]
    hashes = mix(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > LONG_WORD):
        hashes[i] = int.from_bytes(blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, starts


class Shingled(NamedTuple):
    """Distinct shingles of some texts, sorted within each text; ``sizes`` says how many each text has."""

    values: np.ndarray
    sizes: np.ndarray


def shingle(texts: list[str], words: int) -> Shingled:
    """Distinct ``words``-word shingles of each text: A-Z lower-cased, words between ASCII white space.

    A text with fewer words is one shingle, its whole sequence; one without words has none.
    """
    found, docs = [], []
    data = [t.encode().lower() for t in texts]
    at = 0
    while at < len(data):
        end, size = at, 0
        while end < len(data) and (end == at or size + len(data[end]) < BLOCK):
            size += len(data[end]) + 1
            end += 1
        for values, of in _shingle_some(data[at:end], words):
            found.append(values)
            docs.append(of + at)
        at = end
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    of = np.concatenate(docs) if docs else np.zeros(0, np.int64)
    # Sorting the whole lot by text and value at once would be slower than text by text.
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    parts = [np.unique(values[a:b]) for a, b in zip(edges, edges[1:])]
    return Shingled(np.concatenate(parts) if parts else values, np.array([len(p) for p in parts], np.int64))


def _shingle_some(data: list[bytes], words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shingles (repeats included) and the text that each is of, for texts of together one block, or one long text."""
    joined = b" ".join(data)
    first = np.cumsum([0, *[len(d) + 1 for d in data[:-1]]])
    hashes, starts = [], []
    at, whole = 0, np.frombuffer(joined, np.uint8)
    while at < len(whole):
        end = min(len(whole), at + BLOCK)
        while end < len(whole) and not _SPACE[whole[end]]:  # up to the end of the word
            stop = np.flatnonzero(_SPACE[whole[end:end + BLOCK]])
            end = end + int(stop[0]) if len(stop) else min(len(whole), end + BLOCK)
        h, s = _block_words(whole[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return
    h, of = np.concatenate(hashes), np.searchsorted(first, np.concatenate(starts), side="right") - 1
    counts = np.bincount(of, minlength=len(data))
    if len(h) >= words:
        value = h[:len(h) - words + 1]
        for k in range(1, words):
            value = mix(value * _U(_BASE) + h[k:len(h) - words + 1 + k])
        same = of[:len(h) - words + 1] == of[words - 1:]
        long = value[same], of[:len(h) - words + 1][same]
    else:
        long = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < words))
    begin = np.cumsum(counts) - counts
    values, texts = [long[0]], [long[1]]
    for i in short:
        value = np.array([counts[i]], np.uint64)
        for word in h[begin[i]:begin[i] + counts[i], None]:
            value = mix(value * _U(_BASE) + word)
        values.append(value)
        texts.append(np.array([i], np.int64))
    of = np.concatenate(texts)
    order = np.argsort(of, kind="stable")
    yield np.concatenate(values)[order], of[order]


def set_digests(shingled: Shingled) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set; empty sets have 0."""
    out = []
    filled = shingled.sizes > 0
    begin = (np.cumsum(shingled.sizes) - shingled.sizes)[filled]
    for salt in (0x1234567, 0x89ABCDE):
        digest = np.zeros(len(shingled.sizes), np.uint64)
        if len(begin):
            digest[filled] = np.add.reduceat(mix(shingled.values ^ _U(salt)), begin)
        out.append(digest.view(np.int64))
    return out[0], out[1]
