"""Secrets: a base grammar, and novelty under a primed compressor.

Long strings near a word that announces a secret are candidates. Each is measured by how many bytes it adds when
zstandard compresses it after the text around it, primed with the identifiers that the corpus uses in such places.
A string that repeats its surroundings or known identifiers adds little; a random key adds nearly all it has.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.llm.common import id_and_text, portions, staged, texts_of

# The base grammar, the kinds in their order, and words that announce a secret.
KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
SENSITIVE = re.compile(r"passw|passphrase|secret|token|api[_-]?key|credential|bearer|private[_-]?key|signature", re.I | re.A)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+")
WORD = re.compile(r"[A-Za-z_]{3,32}")
#: Characters before a candidate in which a sensitive word counts, and that are its surroundings on each side.
NEAR, AROUND = 48, 200
#: Identifiers in the dictionary, and the share and number of new bytes from which a candidate is reported.
DICTIONARY, NEW_SHARE, NEW_BYTES = 2000, 0.68, 12


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base grammar, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, surroundings) of long strings of letters and digits after a sensitive word, outside base spans.

    The word counts if it begins at most ``NEAR`` characters before the string.
    """
    near = [m.start() for m in SENSITIVE.finditer(text)]
    if not near:
        return []
    found = []
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    for m in CANDIDATE.finditer(text):
        at = bisect_left(near, m.start() - NEAR)
        if at == len(near) or near[at] >= m.start() or not (re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])):
            continue
        i = bisect_left(starts, m.end())
        if i and ends[i - 1] > m.start():  # of the spans that begin before its end, one ends after its start
            continue
        found.append((m.start(), m.end(), text[max(0, m.start() - AROUND):m.start()] + "\n" + text[m.end():m.end() + AROUND]))
    return found


def new_bytes(candidate: str, surroundings: str, compressor) -> int:
    """What ``candidate`` adds to the compressed size of ``surroundings``."""
    before = surroundings.encode()
    return len(compressor.compress(before + candidate.encode())) - len(compressor.compress(before))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, base`` (spans) and ``candidates`` (with value and surroundings) of every whole text."""
    source = id_and_text(docs, id_col, text_col)
    span = [("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]
    candidate = [("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("around", pa.string())]
    schema = (f"id {source.schema['id'].dataType.simpleString()}, base array<struct<start:int,kind:int,end:int>>, "
              "candidates array<struct<start:int,end:int,value:string,around:string>>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            base, more = [], []
            for text in texts_of(batch):
                own = base_spans(text)
                base.append([dict(zip(("start", "kind", "end"), s)) for s in own])
                more.append([{"start": s, "end": e, "value": text[s:e], "around": a} for s, e, a in candidates(text, own)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(base, pa.list_(pa.struct(span))), pa.array(more, pa.list_(pa.struct(candidate)))],
                names=["id", "base", "candidates"])

    return source.mapInArrow(run, schema)


def identifier_dictionary(scanned: DataFrame, size: int = DICTIONARY) -> bytes:
    """The most frequent identifiers of all candidates' surroundings, the most frequent last (nearest to the text)."""
    words = scanned.select(F.explode("candidates.around").alias("around")).select(
        F.explode(F.regexp_extract_all("around", F.lit(r"[A-Za-z_]{3,32}"), F.lit(0))).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(size).collect()
    return " ".join(r["word"] for r in reversed(top)).encode()


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = NEW_SHARE,
                 least: int = NEW_BYTES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel`` of every row.

    Counts and the digest are of base spans; ``spans`` has all as ``kind:start:end`` by start, then kind, in code points with
    the end excluded. Null and empty texts have none; repeated rows and null ids stay; an empty table gives no
    rows; extra columns are ignored.
    """
    scanned = staged(scan(docs, id_col, text_col), "secrets")
    primer = identifier_dictionary(scanned)
    schema = T.StructType([T.StructField("doc_id", scanned.schema["id"].dataType)]).add("n_assign", "long").add(
        "n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string").add("n_novel", "long")

    def named(spans: list) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        primed = {"dict_data": zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if primer else {}
        compressor = zstandard.ZstdCompressor(level=9, write_content_size=False, **primed)
        for batch in batches:
            rows = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                base = [(s["start"], s["kind"], s["end"]) for s in base]
                novel = []
                for c in more:
                    new = new_bytes(c["value"], c["around"], compressor)
                    if new >= least and new >= share * len(c["value"]):
                        novel.append((c["start"], 3, c["end"]))
                rows.append((*[sum(k == kind for _, k, _ in base) for kind in range(3)],
                             hashlib.sha256(named(base).encode()).hexdigest(), named(base + novel), len(novel)))
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]], names=schema.names)

    return scanned.mapInArrow(run, schema)
