"""Chat formatting at the level of tokens.

A turn is ``<|im_start|>role``, a line end, its text, ``<|im_end|>`` and a line end. The two marks are reserved ids after the
vocabulary's own, so no text can make them: roles and texts are encoded by themselves, all of a batch in one call, and
the reserved ids are spliced in between at places that prefix sums of the segments' lengths give. The loss mask is a
prefix sum too: plus one where a text to learn begins, minus one behind it.

Control strings inside roles and texts are escaped as well, so that the formatted text, written out, has marks only where
the template put them: ``<`` with any number of backslashes and ``|`` gets one backslash more; reading back takes one away.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.llm.common import portions
from skyloom.llm.tokens import byte_level

START, END = "<|im_start|>", "<|im_end|>"
LEARNT = ("assistant",)
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)
#: Bytes of text that a task formats at a time; a longer text goes by itself.
PORTION = 1 << 21


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role in one line: backslashes are doubled, line ends become ``\\n``, and a bar after ``<`` gets a backslash."""
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|")


def unescape_role(text: str) -> str:
    return _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


class Template:
    """Marks and pieces of the template as ids of a byte-level tokenizer; made once in a Python worker."""

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = byte_level(path, ranks)
        self.start, self.end = self.tokenizer.size, self.tokenizer.size + 1
        self.line = np.array(self.tokenizer.encode(["\n"])[0], np.int64)

    def format(self, roles: list[str], texts: list[str], learnt: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all turns in a row, their loss mask, and where each turn ends."""
        n = len(roles)
        known = list(dict.fromkeys(roles))
        known = dict(zip(known, self.tokenizer.encode([escape_role(r) for r in known])))
        heads = [known[r] for r in roles]
        bodies = self.tokenizer.encode([escape(t) for t in texts])
        sizes = np.ones((n, 6), np.int64)  # start mark, role, line end, text, end mark, line end
        sizes[:, 1], sizes[:, 3] = list(map(len, heads)), list(map(len, bodies))
        sizes[:, [2, 5]] = len(self.line)
        ends = np.cumsum(sizes).reshape(n, 6)
        starts = ends - sizes
        total = int(ends[-1, -1]) if n else 0
        ids = np.empty(total, np.int64)
        ids[starts[:, 0]], ids[starts[:, 4]] = self.start, self.end
        for column, lists in ((1, heads), (3, bodies)):
            size = sizes[:, column]
            at = np.repeat(starts[:, column] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            ids[at] = np.fromiter((i for own in lists for i in own), np.int64, len(at))
        for column in (2, 5):
            ids[starts[:, column][:, None] + np.arange(len(self.line))] = self.line
        change = np.zeros(total + 1, np.int64)
        told = np.array([r in learnt for r in roles], bool)
        np.add.at(change, starts[told, 3], 1)
        np.add.at(change, ends[told, 3], -1)
        return ids, np.cumsum(change)[:total].astype(bool), ends[:, 5] if n else np.zeros(0, np.int64)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> tuple[str, str, bool, int]:
        """Role, text, whether the text is under the mask, and characters of the written form, of one turn's ids."""
        if len(ids) < 4 or ids[0] != self.start:
            raise ValueError("a turn begins with its mark")
        end = int(np.flatnonzero(ids == self.end)[0])
        inner = self.tokenizer.bytes.join(ids[1:end]).decode()
        role, _, text = inner.partition("\n")
        under = self.tokenizer.bytes.join(ids[np.flatnonzero(mask)]).decode()
        rest = self.tokenizer.bytes.join(ids[end + 1:]).decode()
        if under not in ("", text):
            raise ValueError("the mask covers more or less than the text")
        return unescape_role(role), unescape(text), bool(mask.any()), len(START) + len(inner) + len(END) + len(rest)


_TEMPLATES: dict[tuple, Template] = {}


def template(*paths) -> Template:
    if paths not in _TEMPLATES:
        _TEMPLATES[paths] = Template(*paths)
    return _TEMPLATES[paths]


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    return df.select(df[conv_col].alias("conv_id"), df[turn_col].alias("turn"), F.coalesce(df[role_col], F.lit("")).alias("role"),
                     F.coalesce(df[text_col], F.lit("")).alias("text"))


def format_turns(conversations: DataFrame, path: str, ranks: str | None = None, conv_col: str = "conv_id", turn_col: str = "turn",
                 role_col: str = "role", text_col: str = "text", learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """``conv_id, turn, ids, mask`` of every row: a turn's tokens, and which of them are learnt from. See ``ByteLevel`` for ``ranks``.

    Null roles and texts count as empty. A turn is formatted where its row lies; nothing is shuffled, so a conversation with a
    large share of all rows is no burden. Put turns one after the other for the whole conversation (``token_places``).
    """
    source = _turns(conversations, conv_col, turn_col, role_col, text_col)
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path, ranks)
        for batch in portions(batches, text_at=3, most=PORTION):
            ids, mask, ends = own.format(batch.column(2).to_pylist(), batch.column(3).to_pylist(), learnt)
            offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(mask, pa.bool_()))], names=["conv_id", "turn", "ids", "mask"])

    return source.mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, ids array<int>, mask array<boolean>")


def token_places(formatted: DataFrame) -> DataFrame:
    """``formatted`` with ``first_token``: where each turn's tokens begin in its conversation, a prefix sum over the turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "ids").rowsBetween(Window.unboundedPreceding, -1)
    return formatted.withColumn("first_token", F.coalesce(F.sum(F.size("ids").cast("long")).over(order), F.lit(0)))


def read_turns(formatted: DataFrame, path: str) -> DataFrame:
    """``conv_id, turn, role, text, learnt, chars`` from ids and mask alone: what was formatted, unescaped."""
    kinds = {f.name: f.dataType.simpleString() for f in formatted.schema}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = template(path)
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            ids, mask = (batch.column(c).values.to_numpy(zero_copy_only=False) for c in (2, 3))
            rows = [own.read(ids[i:j].astype(np.int64), mask[i:j].astype(bool)) for i, j in zip(ends, ends[1:])]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 *[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.bool_(), pa.int64()))]],
                names=["conv_id", "turn", "role", "text", "learnt", "chars"])

    return formatted.select("conv_id", "turn", "ids", "mask").mapInArrow(
        run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role string, text string, learnt boolean, chars long")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of ``read_turns``' rows.

    A digest runs over a conversation from its first turn to its last, so a conversation's turns go to one task, sorted; the
    task streams them and holds one batch, whatever the conversation's length. Turns with one number are ordered by
    role and text; turns without a number come first.
    """
    key = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # conversation, turns, digest, characters learnt, their digest, characters

        def closed() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def block(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                              names=[part.split(" ")[0] for part in schema.split(", ")])

        for batch in batches:
            key_type, done = batch.column(0).type, []
            for conv, _, role, text, told, chars in zip(*[c.to_pylist() for c in batch.columns]):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if told:
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += chars
            if done:
                yield block(done)
        if state is not None:
            yield block([closed()])

    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, schema)


def conversation_check(conversations: DataFrame, path: str, ranks: str | None = None, **columns) -> DataFrame:
    """Format every conversation, read it back from the tokens, and keep the digests of what came back.

    Null roles and texts count as empty; rows without a conversation id are one conversation; repeated rows are turns
    each; an empty table gives no rows; extra columns are ignored.
    """
    return conversation_digests(read_turns(format_turns(conversations, path, ranks, **columns), path))
