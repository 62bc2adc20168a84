import datetime

import pytest
from pyspark.sql import types as T

# One text of each odd kind, and rows that repeat. Ids may be null, and further columns have clashing names.
ODD = [None, "", " \t\n", "a", "A", "same text here for all", "same text here for all", "Same Text here for ALL",
       "é😀 ñ ß İ", "x" * 60_000, "word " * 12_000, "line one.\nline two.\r\n" * 800, "<|endoftext|> a <|startoftext|>"]

CLASHING = ["id", "key", "node", "n", "row", "score", "length", "rank", "base", "tokens"]


@pytest.fixture
def odd_docs(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                           *[T.StructField(c, T.DateType()) for c in CLASHING]])
    rows = [(i, t) for i, t in enumerate(ODD)] + [(5, ODD[5]), (None, "no id here at all"), (None, "no id here at all")]
    return spark.createDataFrame([(*r, *[datetime.date(2020, 1, 1)] * len(CLASHING)) for r in rows], schema)


@pytest.fixture
def docs_of(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, text string")

    return make
