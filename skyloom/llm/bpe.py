"""Byte-pair encoding by backtracking, and decoding from an offset table.

A piece of text is encoded left to right: take the longest token that starts here, found by one Aho-Corasick pass over the
piece, if the token before it and it may stand side by side; otherwise try the next shorter token that begins it,
and with none left go back one token. Two tokens may stand side by side if merging their bytes in rank order gives
just these two. Places from which no encoding goes on are marked, so each is left once, and a piece takes time in
proportion to its length. The outcome is that of merging in rank order, without doing the merges.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import id_and_text, portions, texts_of

# White space as the tokenizer file's pattern takes it, and that pattern.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{L}+|\x20?\p{N}+|\x20?[^" + SPACE + r"\p{L}\p{N}]+|["
           + SPACE + r"]+(?![^" + SPACE + "])|[" + SPACE + "]+")
#: Anything but single blanks and line ends between other characters.
UNEVEN_SPACE = re.compile(r"\s\s|[^\S \n]|\A\s|\s\Z").search
#: Stretches that are a word of letters whose class is the same in every Unicode version, and ASCII signs behind it.
PLAIN_WORD = re.compile(r"([ ]?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?").fullmatch
#: Encoded stretches that a Python worker keeps in each of two generations, and the longest that it keeps.
CACHED_PIECES, CACHED_LENGTH = 400_000, 48


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of the vocabulary file: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Tokens, merges and the tables that encoding and decoding need. Ids of merged tokens rise with their rank."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        alphabet, vocab = byte_alphabet(), content["model"]["vocab"]
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        plain = {token: i for token, i in vocab.items() if token not in self.special}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in plain.items():
            self.bytes[i] = raw(token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in content["model"]["merges"]]
        self.pair = {(vocab[a], vocab[b]): vocab[a + b] for a, b in merges}
        self.parts = {i: (i, i) for i in plain.values()}
        for (left, right), merged in self.pair.items():
            self.parts[merged] = (left, right)
        self.length = [len(b) for b in self.bytes]
        by_bytes = {self.bytes[i]: i for i in plain.values()}
        self.shorter = {i: next((by_bytes[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in by_bytes), None)
                        for b, i in by_bytes.items()}
        self.automaton = ahocorasick.Automaton()
        for b, i in by_bytes.items():
            self.automaton.add_word(b.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.offsets = np.concatenate([[0], np.cumsum([len(b) for b in self.bytes])]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.find_pieces = regex.compile(PATTERN).findall
        self.split_special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.decimal = list(map(str, range(size)))
        self.fits: dict[tuple[int, int], bool] = {}
        # Stretch -> packed and decimal ids. What is looked up moves to the young generation, so frequent ones are never lost.
        self.young: dict[str, tuple[bytes, str]] = {}
        self.old: dict[str, tuple[bytes, str]] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left + right`` in rank order ends with these two tokens.

        Both are taken apart again, the later merge first. If two parts that face each other have a merge of their own
        that ranks before the merge just undone, it would have been done instead.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        key, bound, good = (left, right), len(self.bytes), True
        while True:
            merged = self.pair.get((left, right))
            if merged is not None and merged < bound:
                good = False
                break
            inner_left, inner_right = self.parts[left][1], self.parts[right][0]
            can_left, can_right = inner_left != left, inner_right != right
            if not (can_left or can_right):
                break
            if can_left and (left > right or not can_right):
                bound, left = left, inner_left
            else:
                bound, right = right + 1, inner_right
        if len(self.fits) > 2_000_000:
            self.fits = {}
        self.fits[key] = good
        return good

    def encode_piece(self, piece: str) -> list[int]:
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        longest = [0] * len(text)
        for end, token in self.automaton.iter(text):  # ends rise, so the last token for a start is the longest
            longest[end - self.length[token] + 1] = token
        stuck, tokens, at, token = bytearray(len(text) + 1), [], 0, longest[0]
        while True:
            end = at + self.length[token]
            if not stuck[end] and (not tokens or self.compatible(tokens[-1], token)):
                tokens.append(token)
                if end == len(text):
                    return tokens
                at, token = end, longest[end]
                continue
            token = self.shorter[token]
            while token is None:  # nothing fits here: leave the place for good and shorten the token before it
                stuck[at] = 1
                last = tokens.pop()
                at -= self.length[last]
                token = self.shorter[last]

    def pieces(self, text: str) -> list[str]:
        if not self.special or not any(s in text for s in self.special):
            return self.find_pieces(text)
        found: list[str] = []
        for part in self.split_special(text):
            found += [part] if part in self.special else self.find_pieces(part)
        return found

    def stretches(self, text: str) -> list[str]:
        """``text`` in stretches that encode on their own, found without the pattern where white space is plain.

        Where no two white spaces meet, a blank always begins the piece of the word after it and a line end is a piece.
        """
        if not text or "\0" in text or UNEVEN_SPACE(text) or any(s in text for s in self.special):
            return self.pieces(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _encoded(self, stretch: str) -> tuple[bytes, str]:
        word = PLAIN_WORD(stretch)
        if word:
            if word[2]:  # its parts are known more often than the whole
                known, signs = self.young.get(word[1]) or self._encoded(word[1]), self._packed(self.encode_piece(word[2]))
                return known[0] + signs[0], known[1] + "," + signs[1]
            ids = self.encode_piece(stretch)
        else:
            ids = []
            for piece in self.pieces(stretch):
                ids += [self.special[piece]] if piece in self.special else self.encode_piece(piece)
        return self._packed(ids)

    def _packed(self, ids: list[int]) -> tuple[bytes, str]:
        return array("I", ids).tobytes(), ",".join(map(self.decimal.__getitem__, ids))

    def encode(self, text: str) -> tuple[np.ndarray, str]:
        """The ids of ``text``, and the same as decimal numbers joined by commas."""
        stretches = self.stretches(text)
        found = list(map(self.young.get, stretches))
        if None in found:
            own: dict[str, tuple[bytes, str]] = {}
            for i, known in enumerate(found):
                if known is None:
                    stretch = stretches[i]
                    found[i] = known = own.get(stretch) or self.old.get(stretch) or self._encoded(stretch)
                    own[stretch] = known
            self.young.update((s, k) for s, k in own.items() if len(s) <= CACHED_LENGTH)
            if len(self.young) > CACHED_PIECES:
                self.young, self.old = {}, self.young
        return np.frombuffer(b"".join([k[0] for k in found]), "<u4"), ",".join([k[1] for k in found])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``: the table's stretches, one after the other. A large array goes in blocks."""
        done = []
        for at in range(0, len(ids), 1 << 20):
            some = ids[at:at + (1 << 20)]
            first, size = self.offsets[some], self.offsets[some + np.uint32(1)] - self.offsets[some]
            shift = first - (np.cumsum(size) - size)
            done.append(self.blob[np.repeat(shift, size) + np.arange(size.sum())].tobytes())
        return b"".join(done)


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, loaded once in each Python worker."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def _per_document(docs: DataFrame, id_col: str, text_col: str, fields: list[T.StructField], make) -> DataFrame:
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", source.schema["id"].dataType), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            columns = list(zip(*[make(text) for text in texts_of(batch)])) or [()] * len(fields)
            types = [pa.list_(pa.int64()) if isinstance(f.dataType, T.ArrayType) else
                     pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in fields]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names)

    return source.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: every whole text's ids. Null and empty texts have none; repeated rows stay; extra columns are ignored."""
    return _per_document(docs, id_col, text_col, [T.StructField("ids", T.ArrayType(T.LongType()))],
                         lambda text: (vocabulary(path).encode(text)[0].astype(np.int64),))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``doc_id, ids``. Null ids give an empty text; bytes that are no UTF-8 become U+FFFD."""
    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [vocabulary(path).decode(np.array(ids or [], np.uint32)).decode("utf-8", "replace")
                     for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids")).mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encode every whole text, decode it again, and keep the digests.

    Null and empty texts have no ids, and both digests are that of nothing. Repeated rows and null ids stay as
    they are; an empty table gives no rows; extra columns are ignored whatever their names.
    """

    def digests(text: str) -> tuple[int, str, str]:
        own = vocabulary(path)
        ids, decimal = own.encode(text)
        decoded = own.decode(ids).decode("utf-8", "replace")
        return len(ids), hashlib.sha256(decimal.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return _per_document(docs, id_col, text_col, [
        T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType())], digests)
