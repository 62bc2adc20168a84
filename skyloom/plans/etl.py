"""The whole load: feeds in, four tables out, all airports in one plan."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators.airports import (
    accepted_airports,
    airport_defaults,
    build_airport,
    extend_airport_defaults,
    rejected_airports,
)
from skyloom.operators.asof import as_of
from skyloom.operators.delays import daily_delays
from skyloom.operators.movements import build_aircraft, build_flights, clean_movements
from skyloom.schemas import SYNC_KEYS
from skyloom.session import materialise
from skyloom.sources import ledger
from skyloom.sources.feeds import read_airport_feed, read_flight_feed
from skyloom.sources.tables import (
    FlightTables,
    append_delays,
    append_flights,
    create_tables,
    insert_new_aircraft,
    load_airports,
    read_tables,
    refresh_catalog,
)


def run_etl(
    spark: SparkSession, feed_root: str, table_root: str, multi_line: bool = False,
    airports: Sequence[str] | None = None, since: int | None = None, until: int | None = None, repeat: str = "append",
) -> FlightTables:
    """Load ``feed_root/airports`` and ``feed_root/flights`` into the tables under ``table_root``.

    ``airports`` (codes), ``since`` and ``until`` (first and last ``ingest_seq``) choose what to load; in an archive, files of
    other airports and syncs are not opened. Airport documents are all read: they tell the defaults and the state before ``since``.
    ``repeat`` says what becomes of syncs that were loaded before; see ``load_feed``.
    """
    feed = read_flight_feed(spark, f"{feed_root}/flights", multi_line, airports, since, until)
    return load_feed(feed, read_airport_feed(spark, f"{feed_root}/airports", multi_line), table_root, repeat=repeat)


def sync_documents(syncs: DataFrame, airports: DataFrame) -> DataFrame:
    """``airport_iata, ingest_seq, own_seq, own_doc, accepted`` of every sync (SYNC_KEYS) whose airport has a document at all.

    A sync goes with the last airport document at or before it. The first document stands in for syncs before it, as feeds
    may be stored in either order.
    """
    states = airports.select(F.col("iata_code").alias("airport_iata"), "ingest_seq", "doc_id", F.col("ingest_seq").alias("own_seq"),
                             (F.size("missing") == 0).alias("accepted"))
    found = as_of(syncs, states, "airport_iata", "ingest_seq", ["doc_id"], ["own_seq", "doc_id", "accepted"], or_first=True)
    return found.filter("state IS NOT NULL").select(
        *SYNC_KEYS, "state.own_seq", F.col("state.doc_id").alias("own_doc"), "state.accepted")


def load_feed(feed: DataFrame, airport_docs: DataFrame, table_root: str, database: str | None = None,
              repeat: str = "append") -> FlightTables:
    """Load flight and airport documents; the result's ``skipped`` says which airport documents were left out, and why.

    Each sync is decided by its own airport document (``sync_documents``): where that lacks a column, or the airport has
    none, the sync's flights are skipped, and an airport row is loaded only from documents that a sync with flights goes with.
    The cleaned rows are written once to the shared
    folder, since three tables are made from them: the JSON is parsed once, each table then reads only
    its columns, and a lost executor costs a task and not the parse. The airport rows and defaults are
    written too, so the planner knows their true size when it chooses the joins. Skipped syncs are few, so they are what
    the cleaned rows are compared with.

    Flights and delays are one load, which counts when both are written: what a broken-off call left is never seen. A sync that
    was loaded before is stored once more (``repeat="append"``), takes the place of its older rows (``"replace"``), or is
    left as it is (``"skip"``).
    """
    if repeat not in ("append", "replace", "skip"):
        raise ValueError("repeat is append, replace or skip")
    spark = feed.sparkSession
    create_tables(spark, table_root)
    airports = materialise(build_airport(airport_docs))
    defaults = materialise(extend_airport_defaults(airport_defaults(spark), airports))

    flying = feed.filter(F.col("airport_iata").isNotNull() & (
        (F.coalesce(F.size("arrivals"), F.lit(0)) > 0) | (F.coalesce(F.size("departures"), F.lit(0)) > 0)))
    everything = materialise(clean_movements(flying, defaults))
    syncs = everything.select(*SYNC_KEYS).distinct()
    decided = materialise(sync_documents(syncs, airports))
    loaded = decided.filter("accepted")
    if repeat == "skip":
        known = ledger.syncs(spark, table_root, ledger.live(spark, table_root)[0]).select(
            F.col("airport_iata").alias("known_airport"), F.col("ingest_seq").alias("known_seq"))
        loaded = loaded.join(known, F.col("airport_iata").eqNullSafe(F.col("known_airport"))
                             & F.col("ingest_seq").eqNullSafe(F.col("known_seq")), "left_anti")
    skipped = materialise(syncs.join(loaded, [syncs[k].eqNullSafe(loaded[k]) for k in SYNC_KEYS], "left_anti"))
    cleaned = everything.join(skipped, [everything[k].eqNullSafe(skipped[k]) for k in SYNC_KEYS], "left_anti")

    used = loaded.select(F.col("airport_iata").alias("iata_code"), F.col("own_seq").alias("ingest_seq"),
                         F.col("own_doc").alias("doc_id")).distinct()
    load_airports(_only(accepted_airports(airports), used, "left_semi"), table_root, database)
    insert_new_aircraft(build_aircraft(cleaned), table_root)
    load = ledger.new_load()
    append_flights(build_flights(cleaned, SYNC_KEYS), table_root, database=database, load=load)
    append_delays(daily_delays(cleaned, SYNC_KEYS), table_root, database=database, load=load)
    ledger.record_syncs(loaded, table_root, load)
    ledger.commit_load(spark, table_root, load, replacing=repeat == "replace")
    if database:
        refresh_catalog(spark, table_root, database)
    return replace(read_tables(spark, table_root), skipped=skipped_airports(airports, used))


def _only(airports: DataFrame, used: DataFrame, how: str) -> DataFrame:
    return airports.join(used, [airports[k].eqNullSafe(used[k]) for k in ("iata_code", "ingest_seq", "doc_id")], how)


def skipped_airports(airports: DataFrame, used: DataFrame) -> DataFrame:
    """``iata_code, reason`` of each airport document that was not loaded: what it lacks, or that it has no flights."""
    lacking = rejected_airports(airports).select(
        "iata_code", F.concat(F.lit("missing: "), F.array_join("missing", ", ")).alias("reason"))
    idle = _only(accepted_airports(airports), used, "left_anti").select("iata_code", F.lit("no flight data").alias("reason"))
    return lacking.unionByName(idle)
