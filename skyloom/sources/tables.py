"""The four stored tables as Parquet under one root folder.

* ``airport`` is replaced as a whole by every load, as a committed version (``sources.versions``): a failed load leaves the
  old version in place, and of two loads at once the slower one starts again from the faster one's rows.
* ``flights`` (in folders by load and departure date) and ``airport_delays`` are appended to; which loads count stands
  in the ledger (``sources.ledger``), with syncs that a later load replaced. ``compact`` merges small loads.
* ``aircraft`` is bucketed by registration, so that new rows are compared with stored ones without shuffling these.

Writes ask for a rebalance: adaptive execution then aims at full-size files and splits a partition
value that holds much of the data over several tasks.
"""

from __future__ import annotations

import hashlib
import urllib.parse
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.operators.airports import upsert_airports
from skyloom.operators.dedupe import first_per_key
from skyloom.schemas import AIRCRAFT, AIRPORT, AIRPORT_DELAYS, FLIGHTS, ORDER_COLUMNS, SYNC_KEYS, TABLES, conform
from skyloom.session import no_rows
from skyloom.sources import ledger, versions

#: Columns of the tables that are stored by load, beside their own: which sync a row comes from, and the folders.
_HIDDEN = {
    "flights": [T.StructField("synced_airport", T.StringType()), T.StructField("ingest_seq", T.LongType())],
    "airport_delays": [T.StructField("ingest_seq", T.LongType())],
}
_FOLDERS = {
    "flights": [T.StructField("load", T.StringType()), T.StructField("flight_date", T.DateType())],
    "airport_delays": [T.StructField("load", T.StringType())],
}
_SYNCED = {"flights": "synced_airport", "airport_delays": "airport_iata"}
#: Buckets of ``aircraft``. Fixed once a table is there: its files are named by bucket.
AIRCRAFT_BUCKETS = 32


@dataclass(frozen=True)
class FlightTables:
    """One DataFrame per stored table; after a load also the airports that were skipped, with the reason."""

    airport: DataFrame
    flights: DataFrame
    aircraft: DataFrame
    airport_delays: DataFrame
    skipped: DataFrame | None = None


def _stored_schema(table: str) -> T.StructType:
    return T.StructType(TABLES[table].fields + _HIDDEN[table] + _FOLDERS[table])


def create_tables(spark: SparkSession, root: str, database: str | None = None) -> None:
    """Create the four tables if absent; with ``database`` also register them in the catalog.

    There ``flights`` and ``airport_delays`` are views of the loads that count in ``flights_loads`` and ``delays_loads``, and
    ``airport`` lies where its newest version does. Give ``database`` to the sinks too, so that what they add shows there
    at once.
    """
    for table in _FOLDERS:
        no_rows(spark, _stored_schema(table)).write.mode("ignore").partitionBy(
            *[f.name for f in _FOLDERS[table]]).parquet(f"{root}/{table}")
    no_rows(spark, ledger.SYNCS).write.mode("ignore").partitionBy("load").parquet(f"{root}/syncs")
    _bucketed(spark, root)
    if not versions.versions(spark, f"{root}/airport"):
        try:
            versions.commit(no_rows(spark, AIRPORT), f"{root}/airport", 0)
        except versions.Conflict:  # another session creates the tables too
            pass
    if database:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
        for table in _FOLDERS:
            by = ", ".join(f"`{f.name}`" for f in _FOLDERS[table])
            spark.sql(f"CREATE TABLE IF NOT EXISTS {_loads_table(database, table)} ({_columns(_stored_schema(table))}) USING parquet "
                      f"PARTITIONED BY ({by}) LOCATION '{root}/{table}'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS `{database}`.`airport` ({_columns(AIRPORT)}) USING parquet "
                  f"LOCATION '{versions.location(spark, f'{root}/airport')}'")
        _bucketed(spark, root, f"`{database}`.`aircraft`")
        for load in ledger.live(spark, root)[0]:
            for table in _FOLDERS:
                _add_partitions(spark, root, table, load, database)
        refresh_catalog(spark, root, database)


def _columns(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)


def _loads_table(database: str, table: str) -> str:
    return f"`{database}`.`{'flights_loads' if table == 'flights' else 'delays_loads'}`"


def _bucketed(spark: SparkSession, root: str, name: str | None = None) -> str:
    """The name under which the session's catalog knows the bucketed ``aircraft`` of ``root``. Only metadata is made."""
    name = name or f"`aircraft_{hashlib.md5(root.encode()).hexdigest()}`"
    files, path, _ = versions.files_of(spark, f"{root}/aircraft")
    files.mkdirs(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_columns(AIRCRAFT)}) USING parquet "
              f"CLUSTERED BY (aircraft_registration) INTO {AIRCRAFT_BUCKETS} BUCKETS LOCATION '{root}/aircraft'")
    spark.catalog.refreshTable(name.replace("`", ""))
    return name


def _add_partitions(spark: SparkSession, root: str, table: str, load: str, database: str) -> None:
    """Tell the catalog the folders of one load, from a listing of that load's folder alone."""
    specs = [f"load='{load}'"]
    if table == "flights":
        files, folder, _ = versions.files_of(spark, f"{root}/{table}/load={load}")
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        dates = [urllib.parse.unquote(n.split("=", 1)[1]) for n in names if n.startswith("flight_date=")]
        specs = [f"load='{load}', flight_date=" + ("null" if d.startswith("__HIVE") else f"DATE'{d}'") for d in dates]
    for at in range(0, len(specs), 200):
        spark.sql(f"ALTER TABLE {_loads_table(database, table)} ADD IF NOT EXISTS "
                  + " ".join(f"PARTITION ({spec})" for spec in specs[at:at + 200]))


def refresh_catalog(spark: SparkSession, root: str, database: str) -> None:
    """Let the catalog's views follow the ledger, and its other tables the files under them."""
    loads, gone = ledger.live(spark, root)
    folder = versions.location(spark, f"{root}/loads")
    for table in _FOLDERS:
        which = ", ".join(f"'{load}'" for load in loads) or "''"
        hidden = "" if gone is None else (
            f" AND NOT EXISTS (SELECT 1 FROM parquet.`{folder}` g WHERE g.gone AND g.load = t.load "
            f"AND g.airport_iata <=> t.{_SYNCED[table]} AND g.ingest_seq <=> t.ingest_seq)")
        columns = ", ".join(f"t.`{c}`" for c in TABLES[table].names)
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{table}` AS SELECT {columns} FROM {_loads_table(database, table)} t "
                  f"WHERE t.load IN ({which}){hidden}")
    spark.sql(f"ALTER TABLE `{database}`.`airport` SET LOCATION '{versions.location(spark, f'{root}/airport')}'")
    for table in ("airport", "aircraft"):
        spark.catalog.refreshTable(f"{database}.{table}")


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.schema(_stored_schema(table)).parquet(f"{root}/{table}")


def _counted(spark: SparkSession, root: str, table: str, live: tuple | None = None) -> DataFrame:
    return ledger.counted(_stored(spark, root, table), *(live or ledger.live(spark, root)), _SYNCED[table])


def read_tables(spark: SparkSession, root: str, views: bool = False) -> FlightTables:
    """The stored tables; ``views`` also makes them the session's temporary views for ``spark.sql``."""
    live = ledger.live(spark, root)
    frames = {
        "airport": versions.read(spark, f"{root}/airport", AIRPORT),
        "flights": _counted(spark, root, "flights", live).select(*FLIGHTS.names),
        "aircraft": spark.read.schema(AIRCRAFT).parquet(f"{root}/aircraft"),
        "airport_delays": _counted(spark, root, "airport_delays", live).select(*AIRPORT_DELAYS.names),
    }
    if views:
        for name, frame in frames.items():
            frame.createOrReplaceTempView(name)
    return FlightTables(**frames)


def load_airports(incoming: DataFrame, root: str, database: str | None = None) -> None:
    """Upsert airport rows and commit the result as the next version, on top of whatever was committed meanwhile."""
    spark = incoming.sparkSession
    versions.replace(spark, f"{root}/airport", AIRPORT,
                     lambda existing: conform(upsert_airports(existing, conform_keyed(incoming)), AIRPORT))
    if database:
        refresh_catalog(spark, root, database)


def conform_keyed(incoming: DataFrame) -> DataFrame:
    """Airport rows in stored types, with the document keys the upsert orders by."""
    return incoming.select(
        "ingest_seq", "doc_id", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in AIRPORT]
    )


def _stored_rows(df: DataFrame, schema: T.StructType, cut_text: bool) -> tuple[DataFrame, list]:
    """``df`` in stored types and widths, with the order and sync columns it has, and the order that says which row is first."""
    order = [c for c in ORDER_COLUMNS if c in df.columns]
    more = [c for c in dict.fromkeys([*order, *SYNC_KEYS]) if c in df.columns and c not in schema.names]
    kept = T.StructType(schema.fields + [df.schema[c] for c in more])
    return conform(df, kept, cut_text), [F.col(c).asc_nulls_first() for c in order or schema.names]


def _hidden(rows: DataFrame, table: str) -> list:
    """The stored columns of a row's sync: NULL where ``rows`` does not tell it."""
    sources = {"synced_airport": "airport_iata", "ingest_seq": "ingest_seq"}
    return [(F.col(sources[f.name]) if sources[f.name] in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in _HIDDEN[table]]


def append_flights(
    df: DataFrame, root: str, dedupe_keys: Sequence[str] | None = None, cut_text: bool = False,
    database: str | None = None, load: str | None = None,
) -> None:
    """Append flight rows.

    Loading the same rows twice stores them twice, as nothing in the table is unique. With
    ``dedupe_keys`` only rows with unseen keys are added, the first of each; NULL keys are equal. Text is
    stored whole; ``cut_text`` cuts it to the columns' widths, before keys are compared. Where the
    departure time is a key, only the stored dates of the batch are read. With ``load`` the rows are part of a load that the
    caller commits; else they count at once.
    """
    spark, table, own = df.sparkSession, "flights", load or ledger.new_load()
    rows, order = _stored_rows(df, FLIGHTS, cut_text)
    departure_date = F.col("scheduled_departure_utc").cast("date")
    if dedupe_keys:
        rows = first_per_key(rows, dedupe_keys, order)
        stored = _counted(spark, root, table)
        seen = stored.select(*[F.col(k).alias(f"seen_{k}") for k in dedupe_keys], "flight_date")
        same = [F.col(k).eqNullSafe(F.col(f"seen_{k}")) for k in dedupe_keys]
        if "scheduled_departure_utc" in dedupe_keys:
            same.append(departure_date.eqNullSafe(F.col("flight_date")))
        rows = rows.join(seen, same, "left_anti")
    _write_flights(rows.select(*FLIGHTS.names, *_hidden(rows, table), departure_date.alias("flight_date")), root, own)
    _done(spark, root, table, own, load, database)


def _write_flights(dated: DataFrame, root: str, load: str) -> None:
    """Write into the folder of ``load``. Its name is no column of the rows, so these are sorted by date alone, a number."""
    dated.hint("rebalance", "flight_date").write.mode("append").partitionBy("flight_date").parquet(f"{root}/flights/load={load}")


def _done(spark: SparkSession, root: str, table: str, own: str, load: str | None, database: str | None) -> None:
    if not load:
        ledger.commit_load(spark, root, own)
    if database:
        _add_partitions(spark, root, table, own, database)
        if not load:
            refresh_catalog(spark, root, database)


def insert_new_aircraft(df: DataFrame, root: str, cut_text: bool = False) -> None:
    """Append aircraft whose registration is not stored yet, the first row of each; stored rows stay as they are."""
    spark = df.sparkSession
    rows, order = _stored_rows(df, AIRCRAFT, cut_text)
    rows = first_per_key(rows, ["aircraft_registration"], order)
    stored = _bucketed(spark, root)
    new_aircraft(spark.table(stored), rows).write.insertInto(stored)


def new_aircraft(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The ``incoming`` rows (one per registration) with an unseen registration, dealt out as the stored buckets are.

    So only the incoming rows are shuffled to meet the stored ones, and each bucket gets one file.
    """
    dealt = incoming.repartition(AIRCRAFT_BUCKETS, "aircraft_registration")
    return dealt.join(existing.select("aircraft_registration"), "aircraft_registration", "left_anti").select(*AIRCRAFT.names)


def append_delays(df: DataFrame, root: str, cut_text: bool = False, database: str | None = None, load: str | None = None) -> None:
    """Append delay summary rows; a repeated sync adds its rows again. See ``append_flights`` for ``load``."""
    spark, table, own = df.sparkSession, "airport_delays", load or ledger.new_load()
    rows, _ = _stored_rows(df, AIRPORT_DELAYS, cut_text)
    rows.select(*AIRPORT_DELAYS.names, *_hidden(rows, table), F.lit(own).alias("load")).hint("rebalance").write.mode(
        "append").partitionBy("load").parquet(f"{root}/{table}")
    _done(spark, root, table, own, load, database)


def compact(spark: SparkSession, root: str, small: int = 64 << 20, database: str | None = None, remove: bool = True) -> list[str]:
    """Merge the loads whose files are smaller than ``small`` bytes on average into one, without rows that no longer count.

    Returns the loads merged. File sizes come from a listing; file contents are not read for it. Readers that began before keep
    their files only with ``remove=False``, which leaves the old folders in place.
    """
    loads, gone = ledger.live(spark, root)
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(
        f"{root}/flights").select(F.regexp_extract("path", "/load=([^/]+)/", 1).alias("load"), "length")
    stale = {r["load"] for r in gone.select("load").distinct().collect()} if gone is not None else set()
    average = {r["load"]: r["size"] for r in sizes.groupBy("load").agg(F.avg("length").alias("size")).collect()}
    merged = [x for x in loads if x in stale or average.get(x, 0) < small]
    if len(merged) < 2 and not stale:
        return []
    own, some = ledger.new_load(), (merged, gone)
    _write_flights(_counted(spark, root, "flights", some).drop("load"), root, own)
    _counted(spark, root, "airport_delays", some).withColumn("load", F.lit(own)).hint("rebalance").write.mode(
        "append").partitionBy("load").parquet(f"{root}/airport_delays")
    ledger.record_syncs(ledger.counted(ledger.syncs(spark, root, merged), merged, gone, "airport_iata"), root, own)
    ledger.merge_loads(spark, root, merged, own, gone)
    if database:
        for table in _FOLDERS:
            _add_partitions(spark, root, table, own, database)
        refresh_catalog(spark, root, database)
    if remove:
        for table in (*_FOLDERS, "syncs"):
            for load in merged:
                files, folder, _ = versions.files_of(spark, f"{root}/{table}/load={load}")
                files.delete(folder, True)
    return merged
