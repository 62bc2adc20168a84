"""Toxicity from subword-bag embeddings.

A word is the mean of the embeddings of its subwords: itself and its character n-grams, hashed to a fixed table. So an
unseen misspelling shares most of its n-grams with words that were seen. A window of eight words is the mean of its
words, fed to a linear softmax; embeddings and softmax are trained jointly in numpy on a bounded sample of
labelled documents. Labels are per document: its odds are a soft maximum over its windows, so a few words in a long text
are not diluted, from which the logarithm of the number of windows is taken, so that length alone adds nothing. A
word counts once in a document: saying it again is no further evidence, and a text repeated any number of times keeps its score.

When the model is done, a subword's part in the two classes' difference is one number. Scoring needs only that table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import id_and_text, let_go, portions, texts_of

#: Subword table, n-gram lengths in bytes with word boundary marks, embedding width, words to a window.
BUCKETS, SHORTEST, LONGEST, WIDTH, WINDOW = 1 << 18, 3, 6, 4, 8
#: The sample that the model is fitted on: at most so many labelled documents of each class.
SAMPLE = 1000
#: Documents of the sample, and share of them, that a subword must stand in.
LEAST_DOCS, LEAST_SHARE = 3, 0.01
THRESHOLD = 0.7
#: Words whose numbers a task keeps in each of two generations.
CACHED_WORDS = 250_000

# ASCII letters are lower-cased; ASCII signs other than letters and digits separate words; other bytes stay.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


#: Marked words of more than ``LONG`` bytes are cut into stretches of ``STRETCH`` that share ``LONGEST - 1``, each a word: so no
#: n-gram is lost or made up, and what stands in a run of words or a script without blanks is diluted no more than among usual words.
LONG, STRETCH = 64, 16
#: Share of a word's subwords that must be known for it to count in full; random strings, of which hardly any are, count less.
KNOWN_SHARE = 0.25
#: The mean over a word's subwords is over so many at least, so that in a short word no single n-gram decides.
LEAST_SUBWORDS = 12
#: Windows up to which the soft maximum is hardly lowered.
FREE_WINDOWS = 50


def words_of(text: str) -> list[bytes]:
    """The distinct words of ``text`` with marks at both ends, in the order in which they first stand."""
    words = list(dict.fromkeys(text.encode().translate(_FOLD).split()))
    step, parts = STRETCH - LONGEST + 1, []
    for word in words:
        word = b"<" + word + b">"
        parts += [word] if len(word) <= LONG else [word[i:i + STRETCH] for i in range(0, len(word) - LONGEST + 1, step)]
    return parts if len(parts) == len(words) else list(dict.fromkeys(parts))


def subwords(word: bytes) -> list[int]:
    """Table places of a marked word: itself and its n-grams."""
    return [zlib.crc32(word) % BUCKETS, *[zlib.crc32(word[i:i + n]) % BUCKETS
            for n in range(SHORTEST, min(LONGEST, len(word)) + 1) for i in range(len(word) - n + 1)]]


class Model(NamedTuple):
    """``parts``: a subword's part in the toxic class minus the clean one; ``bias`` likewise."""

    parts: np.ndarray
    bias: float


def _flat(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All words' table places in a row, and how many each has; held as lists for some thousand words at a time."""
    places, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for at in range(0, len(words), 4096):
        some = [subwords(w) for w in words[at:at + 4096]]
        sizes.append(np.fromiter(map(len, some), np.int32, len(some)))
        places.append(np.fromiter((x for p in some for x in p), np.int32, int(sizes[-1].sum())))
    return np.concatenate(places), np.concatenate(sizes)


def _weights(sizes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """What a word's sum over its subwords is multiplied by: their mean, lowered where few of them are known."""
    return np.minimum(known / (KNOWN_SHARE * sizes), 1.0) / np.maximum(sizes, LEAST_SUBWORDS)


def _document_counts(places: np.ndarray, sizes: np.ndarray, doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """In how many documents each table place stands; ``doc`` and ``word`` are distinct pairs sorted by document."""
    counts = np.zeros(BUCKETS, np.int64)
    first = np.cumsum(sizes) - sizes
    edges = np.flatnonzero(np.diff(doc)) + 1
    for some in np.split(word, edges):
        size = sizes[some]
        at = np.repeat(first[some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        counts[np.unique(places[at])] += 1
    return counts


def fit(texts: list[str], toxic: list[int], rounds: int = 80, rate: float = 0.3, seed: int = 1) -> Model:
    """Embeddings and softmax, trained jointly by Adam on whole batches.

    A document's odds are the sum of its windows' odds over their (smoothed) number, so each step moves mostly the windows
    that say toxic loudest.
    """
    random = np.random.default_rng(seed)
    label = np.array(toxic, np.float32)
    if not len(label) or label.min() == label.max():  # one class only: its (smoothed) odds, whatever the text
        odds = (label.sum() + 1.0) / (len(label) - label.sum() + 1.0)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(odds)))
    known: dict[bytes, int] = {}
    docs = [[known.setdefault(w, len(known)) for w in words_of(t)] or [known.setdefault(b"<>", len(known))] for t in texts]
    places, sizes = _flat(list(known))
    spread = np.repeat(np.arange(len(sizes)), sizes)
    # Subwords of few documents say nothing; they keep the number 0 and count in the means.
    word_in_doc = np.unique(np.concatenate([np.unique(d) + i * len(known) for i, d in enumerate(docs)]))
    in_docs = _document_counts(places, sizes, word_in_doc // len(known), word_in_doc % len(known))
    frequent = in_docs[places] >= max(LEAST_DOCS, LEAST_SHARE * len(docs))
    used, places = np.unique(places[frequent], return_inverse=True)
    spread = spread[frequent]
    word_weight = _weights(sizes, np.bincount(spread, minlength=len(sizes))).astype(np.float32)
    words = np.concatenate([np.array(d, np.int64) for d in docs])
    window_sizes = np.concatenate([np.full(-(-len(d) // WINDOW), WINDOW) for d in docs])
    per_doc = np.array([-(-len(d) // WINDOW) for d in docs])
    window_sizes[np.cumsum(per_doc) - 1] = [len(d) - (n - 1) * WINDOW for d, n in zip(docs, per_doc)]
    window_of = np.repeat(np.arange(len(window_sizes)), window_sizes)
    starts = np.cumsum(per_doc) - per_doc
    weight = np.where(label == 1, 0.5 / label.sum(), 0.5 / (len(label) - label.sum())).astype(np.float32)
    table = (random.standard_normal((len(used), WIDTH)) * 0.1).astype(np.float32)
    softmax = (random.standard_normal((WIDTH, 2)) * 0.1).astype(np.float32)
    bias = np.array([2.0, -2.0], np.float32)
    # Chance moves a subword's gradient by the root of its number of places; dividing by it leaves what is more than chance.
    stands = np.bincount(places, (np.bincount(words, minlength=len(sizes)) * word_weight)[spread], len(used))
    chance = np.sqrt(stands + 1e-6)[:, None].astype(np.float32)
    moments = [np.zeros_like(p) for p in (table, softmax, bias)]
    scales = [0.0, 0.0, 0.0]
    lowered = np.log1p((per_doc - 1) / FREE_WINDOWS).astype(np.float32)
    for step in range(1, rounds + 1):
        vectors = np.stack([np.bincount(spread, table[places, k], len(sizes)) for k in range(WIDTH)], axis=1)
        vectors = vectors.astype(np.float32) * word_weight[:, None]
        windows = np.add.reduceat(vectors[words], np.cumsum(window_sizes) - window_sizes, axis=0) / np.float32(WINDOW)
        odds = (windows @ softmax + bias) @ np.array([-1, 1], np.float32)
        top = np.maximum.reduceat(odds, starts)
        share = np.exp(odds - np.repeat(top, per_doc))
        total = np.add.reduceat(share, starts)
        doc = top + np.log(total) - lowered
        miss = weight * (1 / (1 + np.exp(-doc)) - label)
        slope = np.repeat(miss / total, per_doc) * share
        both = np.stack([-slope, slope], axis=1)
        to_word = (both @ softmax.T) / np.float32(WINDOW)
        # Back to the words and on to their subwords: sums over all places where each stands.
        to_vector = np.stack([np.bincount(words, to_word[window_of, k], len(sizes)) for k in range(WIDTH)], axis=1)
        to_vector *= word_weight[:, None]
        to_table = np.stack([np.bincount(places, to_vector[spread, k], len(used)) for k in range(WIDTH)], axis=1)
        grads = [to_table.astype(np.float32) / chance, windows.T @ both + 1e-5 * softmax, both.sum(axis=0)]
        for i, (value, grad) in enumerate(zip((table, softmax, bias), grads)):
            # One step length for each array, so that a subword moves by what many documents say of it.
            moments[i] += 0.1 * (grad - moments[i])
            scales[i] += 0.05 * (float((grad * grad).max()) - scales[i])
            value -= rate * (moments[i] / (1 - 0.9 ** step)) / (np.sqrt(scales[i] / (1 - 0.95 ** step)) + 1e-12)
    parts = np.zeros(BUCKETS, np.float32)
    parts[used] = table @ (softmax[:, 1] - softmax[:, 0])
    return Model(parts, float(bias[1] - bias[0]))


class Scorer:
    """Scores of whole texts; the words' numbers are kept per Python worker."""

    def __init__(self, model: Model):
        self.model, self.known, self.old = model, {}, {}

    def score(self, text: str) -> float:
        words = words_of(text)
        new = [w for w in words if w not in self.known]
        if new:
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known, self.old, new = {}, self.known, words
            seen = [w for w in new if w in self.old]
            self.known.update(zip(seen, map(self.old.__getitem__, seen)))
            new = [w for w in new if w not in self.old]
        if new:
            places, sizes = _flat(new)
            parts = self.model.parts[places].astype(np.float64)
            first = np.cumsum(sizes) - sizes
            sums, known = np.add.reduceat(parts, first), np.add.reduceat((parts != 0).astype(np.int64), first)
            self.known.update(zip(new, (sums * _weights(sizes, known)).tolist()))
        odds = np.zeros(1)
        if words:
            values = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
            odds = np.add.reduceat(values, np.arange(0, len(words), WINDOW)) / WINDOW
        odds = odds + self.model.bias
        top = odds.max()
        doc = top + np.log(np.exp(odds - top).sum()) - np.log1p((len(odds) - 1) / FREE_WINDOWS)
        return float(1 / (1 + np.exp(-np.clip(doc, -500, 500))))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", per_class: int = SAMPLE) -> DataFrame:
    """``id, text, label`` of at most ``per_class`` documents of each class, the first in a hashed order of their ids.

    ``labels`` should hold only rows that may be learnt from. An id labelled both ways counts as toxic; of an id's
    texts the smallest is taken.
    """
    known = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).filter(
        "id IS NOT NULL AND label IN (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    picked = None
    for value in (0, 1):
        part = known.filter(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # At most 2 * per_class ids and labels.
    return id_and_text(docs, id_col, text_col).join(F.broadcast(picked), "id").groupBy("id", "label").agg(F.min("text").alias("text"))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          per_class: int = SAMPLE) -> Model:
    """A model fitted on the labelled rows outside the held-out third.

    One task fits it, on at most ``2 * per_class`` texts; the driver gets the table of ``BUCKETS`` numbers.
    """
    sample = labelled_sample(docs, labels.filter(~held_out(labels[id_col])), id_col, text_col, label_col, per_class)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns])]
        model = fit([text for text, _ in rows], [label for _, label in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.parts.tobytes()], pa.binary()), pa.array([model.bias])],
                                         names=["parts", "bias"])

    found = sample.repartition(1).sortWithinPartitions("id").select("text", "label").mapInArrow(
        run, "parts binary, bias double").collect()
    return Model(np.frombuffer(found[0]["parts"], np.float32), found[0]["bias"]) if found else fit([], [])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row.

    Null and empty texts, and texts without a word, get the score of a window of nothing. Equal texts get equal scores;
    repeated rows and null ids stay; an empty table gives no rows; extra columns are ignored.
    """
    source = id_and_text(docs, id_col, text_col)
    schema = T.StructType([T.StructField("doc_id", source.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers and a bias

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in portions(batches):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([scorer.score(t) for t in texts_of(batch)], pa.float64())], names=schema.names)

    return source.mapInArrow(run, schema).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", per_class: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Learn from labelled rows outside the held-out third (crc32 of the id as text mod 3 is 1), and score every row.

    See ``labelled_sample`` and ``score_documents`` for odd rows. Without any usable label the score is 0.5.
    """
    return score_documents(docs, learn(docs, labels, id_col, text_col, label_col, per_class), id_col, text_col, threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               label_col: str = "toxic", per_class: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``, with all their columns. Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col, label_col, per_class))
    text_at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        scorer = Scorer(shared.value)
        for batch in portions(batches, text_at):
            texts = ["" if t is None else t for t in batch.column(text_at).to_pylist()]
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
