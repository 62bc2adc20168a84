"""From nested feed documents to flat, typed flight rows.

Every step is a narrow projection; the only join is with the airport defaults, and no step shuffles.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.text import first_word
from skyloom.functions.times import accepted_timestamp, time_text, whole_seconds
from skyloom.operators.dedupe import first_per_key
from skyloom.schemas import AIRCRAFT, FEED_PATHS, FLIGHTS, ORDER_COLUMNS, SYNC_KEYS, TIME_COLUMNS

_SIDES = {"Arrival": "arrival", "Departure": "departure"}
_ENDS = {"Arrival": "destination", "Departure": "origin"}


def explode_feed(feed: DataFrame) -> DataFrame:
    """One row per flight of both lists, tagged ``movement_type``; documents with two empty lists vanish.

    ``movement_rank`` and ``pos`` keep the order of the lists (arrivals first), next to the
    ``airport_iata``, ``ingest_seq`` and ``doc_id`` of the document.
    """

    def tagged(flights: str, movement_type: str, rank: int) -> Column:
        return F.struct(
            F.lit(movement_type).alias("movement_type"),
            F.lit(rank).alias("movement_rank"),
            F.col(flights).alias("flights"),
        )

    document = ["airport_iata", "ingest_seq", "doc_id"]
    lists = F.array(tagged("arrivals", "Arrival", 0), tagged("departures", "Departure", 1))
    tags = ["list.movement_type", "list.movement_rank"]
    return (
        feed.select(*document, F.explode(lists).alias("list"))
        .select(*document, *tags, F.posexplode("list.flights").alias("pos", "flight"))
        .select(*document, "movement_type", "movement_rank", "pos", "flight.*")
    )


def normalise_movement(df: DataFrame) -> DataFrame:
    """Move the short form's ``movement`` to the side the list stands for; an explicit leg wins over it."""
    for movement_type, side in _SIDES.items():
        own = F.when(F.col("movement_type") == movement_type, F.col("movement"))
        df = df.withColumn(side, F.coalesce(F.col(side), own))
    return df.drop("movement")


def fill_airport_defaults(df: DataFrame, defaults: DataFrame) -> DataFrame:
    """Fill the queried airport's missing fields on its own side of each flat flight row.

    ``defaults`` has one row per known airport (``iata``, ``icao``, ``name``, ``country_code``). No
    broadcast is forced: Spark sends it out while it is small and shuffles both sides when it is not. It then splits a
    busy airport only where nothing above the join counts on its rows lying together; ``daily_delays`` deals them
    out anew by time.
    """
    fields = ["iata", "icao", "name", "country_code"]
    known = defaults.select(
        F.col("iata").alias("airport_iata"), *[F.col(field).alias(f"default_{field}") for field in fields]
    )
    filled = {
        f"{end}_{field}": F.coalesce(
            f"{end}_{field}", F.when(F.col("movement_type") == movement_type, F.col(f"default_{field}"))
        )
        for movement_type, end in _ENDS.items()
        for field in fields
    }
    return df.join(known, "airport_iata", "left").withColumns(filled).select(*df.columns)


def ensure_columns(df: DataFrame, columns: Mapping[str, str | T.DataType] | Iterable[str]) -> DataFrame:
    """Add the ``columns`` that ``df`` lacks as NULL; plain names become text."""
    types = columns if isinstance(columns, Mapping) else {name: "string" for name in columns}
    absent = {name: F.lit(None).cast(kind) for name, kind in types.items() if name not in df.columns}
    return df.withColumns(absent) if absent else df


def project_flights(df: DataFrame) -> DataFrame:
    """Pick and rename the feed fields that are used, keeping sync and order columns."""
    kept = list(dict.fromkeys(SYNC_KEYS + ORDER_COLUMNS))
    return df.select(*kept, *[F.col(path).alias(name) for name, path in FEED_PATHS.items()])


def parse_utc(df: DataFrame, columns: Iterable[str] = tuple(TIME_COLUMNS)) -> DataFrame:
    """Parse text ``columns`` to naive UTC timestamps; columns that ``df`` lacks are skipped."""
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    # Two projections: the second reads each text several times, so they stay apart and compile to methods of their own.
    checked = df.withColumns({c: time_text(F.col(c)) for c in present})
    return checked.withColumns({c: accepted_timestamp(F.col(c)) for c in present})


def sql_safe(df: DataFrame, as_text: bool = False) -> DataFrame:
    """Cut timestamps to whole seconds and turn NaN into NULL; ``as_text`` writes the times as text."""
    changed = {}
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            whole = whole_seconds(column)
            changed[field.name] = whole.cast("string") if as_text else whole
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            changed[field.name] = F.when(~F.isnan(column), column)
    return df.withColumns(changed) if changed else df


def derive_manufacturer(df: DataFrame) -> DataFrame:
    """Add ``aircraft_manufacturer``, the first word of ``aircraft_model``."""
    return df.withColumn("aircraft_manufacturer", first_word(F.col("aircraft_model")))


def clean_movements(feed: DataFrame, defaults: DataFrame) -> DataFrame:
    """All of the above in order: feed documents to flat, typed flight rows.

    Times are parsed below the join and the rest is done above it. Joined into one projection the
    generated method would grow past what the JVM compiles and run several times slower.
    """
    rows = parse_utc(project_flights(normalise_movement(explode_feed(feed))))
    return derive_manufacturer(fill_airport_defaults(rows, defaults))


def build_flights(df: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """The ``flights`` table's columns, and ``more``; codeshare listings stay separate rows."""
    return sql_safe(df.select(*FLIGHTS.names, *more))


def build_aircraft(df: DataFrame) -> DataFrame:
    """One row per registration, the first in feed order."""
    order = [F.col(c).asc_nulls_first() for c in ORDER_COLUMNS]
    registered = df.filter(F.col("aircraft_registration").isNotNull())
    wanted = dict.fromkeys([*AIRCRAFT.names, *ORDER_COLUMNS])
    return first_per_key(registered.select(*wanted), ["aircraft_registration"], order).select(*AIRCRAFT.names)
