"""WARC derivatives: linked metadata and plain-text conversion records of responses, and WARC files of them.

Records are rows: type, identifiers, headers, digests and block. Everything is derived by DataFrame expressions from one
row, so there is no shuffle. Files are written by Spark's text writer: a record is its headers and block, and the two empty
lines that end it are the line separator.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns for the parts of a page, and the entities that are decoded, the ampersand last. What is opened and never
# closed reaches to the page's end, and a tag ends before the next one at the latest, so no pattern looks at a stretch twice.
HIDDEN = [r"(?s)<!--.*?(?:-->|\z)", *[rf"(?is)<{tag}\b.*?(?:</{tag}\s*>|\z)" for tag in ("script", "style", "head")]]
BREAKS = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|body)\b[^<>]*>"
TAG = r"<[^<>]*>"
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}
#: A link: its address in double quotes, in single ones or without any.
LINK = r"""(?i)<a\b[^<>]*\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
SOURCE_TYPE = "application/http; msgtype=response"
#: The date of records whose source has none.
NO_DATE = "1970-01-01T00:00:00Z"
EOL = "\r\n"


def decoded(text: Column) -> Column:
    for entity, character in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def plain_text(html: Column) -> Column:
    """The visible text: one line per block element, blanks collapsed, entities decoded, empty lines left out.

    A page of any length, also of unclosed comments or tags, takes time in proportion to it. An attribute value with ``<`` or ``>``
    ends its tag there, and of entities only ``ENTITIES`` are decoded.
    """
    for pattern in HIDDEN:
        html = F.regexp_replace(html, pattern, "")
    text = F.regexp_replace(F.regexp_replace(html, r"[\r\n\t ]+", " "), BREAKS, "\n")
    text = F.regexp_replace(decoded(F.regexp_replace(text, TAG, "")), "[ ]*\n[ \n]*", "\n")
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def _first(html: Column, pattern: str) -> Column:
    return F.regexp_extract(html, pattern, 1)


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def _identifier(kind: str, *parts: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(kind), *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[
        F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              date: str = NO_DATE) -> DataFrame:
    """Response records of fetched pages: HTTP headers and the page as block. Null pages are empty ones.

    Identifiers come from id, address and payload, so a row makes the same record each time, and repeated rows the same
    records. Null addresses stay null; extra columns are ignored.
    """
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("target_uri"),
                        F.coalesce(pages[html_col], F.lit("")).alias("payload"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.octet_length("payload").cast("string"), F.lit(EOL * 2))
    return rows.select(
        "page_id", F.lit("response").alias("record_type"),
        _identifier("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("target_uri", F.lit("")),
                    F.sha2("payload", 256)).alias("record_id"),
        F.lit(None).cast("string").alias("refers_to"), "target_uri", F.lit(date).alias("date"),
        F.lit(SOURCE_TYPE).alias("content_type"), _digest(F.col("payload")).alias("payload_digest"), "payload",
        F.concat(http, "payload").alias("block")).withColumn("block_digest", _digest(F.col("block")))


def derivatives(source: DataFrame) -> DataFrame:
    """A metadata and a conversion record for each response record.

    Both refer to the response by its identifier, address and date. The metadata block keeps the source's headers and
    digests, the page's title, language and numbers of links; the conversion block is its plain text.
    """
    html = F.col("payload")
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EOL))
    one_line = lambda text: F.trim(F.regexp_replace(decoded(text), r"[\r\n\t ]+", " "))
    metadata = F.concat(
        field("source-content-type", F.col("content_type")),
        field("source-content-length", F.octet_length("block").cast("string")),
        field("source-block-digest", F.col("block_digest")), field("source-payload-digest", F.col("payload_digest")),
        field("title", one_line(_first(html, r"(?is)<title[^<>]*>(.*?)(?:</title|\z)"))),
        field("language", _first(html, r'(?i)<html[^<>]*\blang="([^"]*)"')),
        field("outlinks", F.size(F.regexp_extract_all(html, F.lit(LINK), F.lit(0))).cast("string")))
    kinds = F.array(F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"),
                             metadata.alias("block")),
                    F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                             plain_text(html).alias("block")))
    made = source.select("page_id", "target_uri", "date", F.col("record_id").alias("refers_to"), F.explode(kinds).alias("k"))
    digest = _digest(F.col("k.block"))
    return made.select(
        "page_id", "k.record_type", F.sha2("k.block", 256).alias("block_sha"), "refers_to", "target_uri", "date",
        "k.content_type", digest.alias("payload_digest"), "k.block", digest.alias("block_digest")).select(
        "page_id", "record_type", _identifier("derived", F.col("record_type"), F.col("refers_to"), F.col("block_sha")).alias(
            "record_id"), "refers_to", "target_uri", "date", "content_type", "payload_digest", "block", "block_digest")


def build(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          date: str = NO_DATE) -> DataFrame:
    """All records of ``pages``: responses, metadata, conversions. An empty table gives no rows."""
    source = responses(pages, id_col, url_col, html_col, date)
    return source.drop("payload").unionByName(derivatives(source))


def _headers() -> Column:
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(EOL))).otherwise("")
    refers = F.col("refers_to").isNotNull()
    return F.concat(
        F.lit(f"WARC/1.1{EOL}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Refers-To", F.col("refers_to")),
        line("WARC-Refers-To-Target-URI", F.when(refers, F.col("target_uri"))),
        line("WARC-Refers-To-Date", F.when(refers, F.col("date"))),
        line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string")), F.lit(EOL))


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files of ``records``, one per partition. A record is written whole."""
    records.select(F.concat(_headers(), "block").alias("value")).write.option("lineSep", EOL * 2).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """``headers`` (lower-case names) and ``block`` of the records in WARC files. A file is read by one task, so keep files
    to some hundred megabytes."""

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, at, headers, blocks = content.as_py(), 0, [], []
                while (start := data.find(b"WARC/", at)) >= 0:
                    end = data.index(b"\r\n\r\n", start)
                    pairs = [line.split(": ", 1) for line in data[start:end].decode().split(EOL)[1:]]
                    own = {name.lower(): value for name, value in pairs}
                    at = end + 4 + int(own["content-length"])
                    headers.append(list(own.items()))
                    blocks.append(data[end + 4:at].decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(headers, pa.map_(pa.string(), pa.string())), pa.array(blocks, pa.string())], names=["headers", "block"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(split, "headers map<string,string>, block string")
