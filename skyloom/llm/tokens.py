"""Public tokenizers as operators on token ids need them: encoders that take any text as plain text, and ids as bytes."""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

import numpy as np

from skyloom.llm.bpe import byte_alphabet

#: Texts that the faster encoder may take: letters whose classes no Unicode version changed, and no white space without end,
#: which its pattern cannot take. Both encoders give the same ids.
_UNUSUAL = re.compile("[^\0-ɏ]|\\s{256}").search


class TokenBytes:
    """The bytes that each id stands for, in one array, so that ids are decoded and measured without loops over them."""

    def __init__(self, raw: Sequence[bytes]):
        self.sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(raw), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        """The bytes of ``ids``, one after the other; a large array goes in blocks."""
        done = []
        for at in range(0, len(ids), 1 << 20):
            some = ids[at:at + (1 << 20)]
            size = self.sizes[some]
            shift = self.starts[some] - (np.cumsum(size) - size)
            done.append(self.blob[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes())
        return b"".join(done)


class ByteLevel:
    """A byte-level tokenizer file. Strings of its special tokens inside a text are plain text.

    ``ranks`` may name the same vocabulary as a list of ranks, whose encoder is faster on usual texts.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        vocab, alphabet = self.tokenizer.get_vocab(with_added_tokens=True), byte_alphabet()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        raw = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            raw[i] = token.encode() if token in special else bytes(alphabet[c] for c in token)
        self.bytes, self.size = TokenBytes(raw), len(raw)
        self.fast = None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as file:
                order = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=order, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> list[list[int]]:
        if not self.fast:
            return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        usual = [not _UNUSUAL(t) for t in texts]
        others = iter(self.tokenizer.encode_batch_fast([t for t, u in zip(texts, usual) if not u], add_special_tokens=False))
        return [self.fast(t) if u else next(others).ids for t, u in zip(texts, usual)]


class Pieces:
    """A sentence-piece model with byte pieces; it puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = TokenBytes([self._raw(i) for i in range(self.size)])

    def _raw(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


_LOADED: dict[tuple, ByteLevel | Pieces] = {}


def byte_level(path: str, ranks: str | None = None) -> ByteLevel:
    """A tokenizer file, loaded once in each Python worker."""
    if (path, ranks) not in _LOADED:
        _LOADED[path, ranks] = ByteLevel(path, ranks)
    return _LOADED[path, ranks]


def pieces(path: str) -> Pieces:
    if (path,) not in _LOADED:
        _LOADED[path,] = Pieces(path)
    return _LOADED[path,]
