"""JSON feeds: one document per airport and sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.schemas import FEED

_FILE_IATA = r"flight_data_([A-Za-z0-9]+)[^/]*$"
_DOC_FIELDS = [T.StructField("ingest_seq", T.LongType()), T.StructField("doc_id", T.StringType())]
_ARCHIVED = T.StructType([*_DOC_FIELDS, *FEED.fields])
# Partition folders; typed here, an airport code of digits stays text.
_FOLDERS = [T.StructField("airport_iata", T.StringType()), T.StructField("sync_from", T.LongType()),
            T.StructField("sync_to", T.LongType())]
_DOCUMENT = ["airport_iata", "ingest_seq", "doc_id", "arrivals", "departures"]


def archive_feed(feed: DataFrame, path: str, syncs_per_folder: int = 1) -> None:
    """Store raw feed documents as JSON Lines, one folder per airport and run of ``syncs_per_folder`` syncs.

    A folder's name tells its airport and its first and last possible sync, so a reader needs no more than the names to
    leave folders out, and folders of different lengths may stand side by side. Archiving a run of syncs of an airport
    again replaces its folder and leaves the others alone: take runs of more than one sync only where a run is always
    archived as a whole. Rows are rebalanced first, so that files have a useful size; a busy airport is split over several tasks.
    Files are compressed, which makes each of them one task of a reader.
    """
    first = F.col("ingest_seq") - F.pmod("ingest_seq", F.lit(syncs_per_folder))
    (
        feed.select("airport_iata", first.alias("sync_from"), (first + (syncs_per_folder - 1)).alias("sync_to"), *_ARCHIVED.names)
        .hint("rebalance", "airport_iata", "sync_from")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "gzip")
        .partitionBy("airport_iata", "sync_from", "sync_to")
        .json(path)
    )


def read_flight_feed(
    spark: SparkSession, path: str, multi_line: bool = False, airports: Sequence[str] | None = None,
    since: int | None = None, until: int | None = None,
) -> DataFrame:
    """Flight documents with ``airport_iata``, ``ingest_seq`` and ``doc_id``.

    Reads an archive written by ``archive_feed`` or, with ``multi_line``, a folder of raw
    ``flight_data_<IATA>.json`` documents, whose airport comes from the file name and whose order is
    the files' modification time. ``airports`` (codes), ``since`` and ``until`` (first and last ``ingest_seq``) choose
    documents: in an archive by its folders, so that files of other airports and syncs are not opened, and in a folder of raw
    documents by the files' names.
    """
    reader = spark.read.schema(T.StructType([*_ARCHIVED.fields, *_FOLDERS])).option("multiLine", multi_line)
    if multi_line:
        if airports is not None:
            reader = reader.option("pathGlobFilter", "flight_data_{" + ",".join([a for a in airports if a.isalnum()] or ["-"]) + "}*")
        feed = _named_by_file(reader.json(path))
    else:
        feed = reader.json(path)
        if since is not None:
            feed = feed.filter(F.col("sync_to") >= since)
        if until is not None:
            feed = feed.filter(F.col("sync_from") <= until)
        feed = feed.select(*_DOCUMENT)
    if airports is not None:
        feed = feed.filter(F.col("airport_iata").isin(list(airports)))
    if since is not None:
        feed = feed.filter(F.col("ingest_seq") >= since)
    if until is not None:
        feed = feed.filter(F.col("ingest_seq") <= until)
    return feed


def _named_by_file(raw: DataFrame) -> DataFrame:
    """Raw documents with the airport, order and name that their files tell."""
    file = F.col("_metadata.file_path")
    return raw.select(
        F.nullif(F.regexp_extract(file, _FILE_IATA, 1), F.lit("")).alias("airport_iata"),
        F.coalesce("ingest_seq", F.unix_micros("_metadata.file_modification_time")).alias("ingest_seq"),
        F.coalesce("doc_id", file).alias("doc_id"),
        "arrivals", "departures",
    )


def read_airport_feed(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Airport documents as a VARIANT column ``doc``, so that an absent field differs from a null one."""
    raw = spark.read.option("singleVariantColumn", "doc").option("multiLine", multi_line).json(path)
    sequence = F.try_variant_get("doc", "$.ingest_seq", "bigint")
    identity = F.try_variant_get("doc", "$.doc_id", "string")
    return raw.select(
        F.coalesce(sequence, F.unix_micros("_metadata.file_modification_time")).alias("ingest_seq"),
        F.coalesce(identity, "_metadata.file_path").alias("doc_id"),
        "doc",
    )
