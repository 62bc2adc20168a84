"""Reports on arrivals, departures, cancellations and delays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.selection import at_airport
from skyloom.operators.dedupe import first_per_key

# The literals the reports test for.
ARRIVAL, DEPARTURE = "Arrival", "Departure"
ARRIVED, CANCELED, DELAYED = "Arrived", "Canceled", "Delayed"


def frequent_routes(flights: DataFrame, iata: str | None = None, min_flights: int = 5) -> DataFrame:
    """Routes by name with more than ``min_flights`` distinct schedules, most first.

    A listing with a missing name or time is not counted.
    """
    named = F.col("origin_name").isNotNull() & F.col("destination_name").isNotNull()
    schedules = F.count_distinct("scheduled_departure_utc", "scheduled_arrival_utc")
    return (
        at_airport(flights, iata, "origin")
        .groupBy("origin_name", "destination_name")
        .agg(schedules.alias("outbound_flights"))
        .withColumn("outbound_flights", F.when(named, F.col("outbound_flights")).otherwise(F.lit(0)))
        .filter(F.col("outbound_flights") > min_flights)
        .orderBy(F.desc("outbound_flights"), "origin_name", "destination_name")
    )


def top_origins(flights: DataFrame, iata: str | None = None, k: int = 3) -> DataFrame:
    """The ``k`` origins with most distinct (flight number, scheduled arrival) pairs."""
    return (
        at_airport(flights, iata, "destination")
        .filter(F.col("movement_type") == ARRIVAL)
        .groupBy(F.col("origin_name").alias("origin_airport"), F.col("origin_iata").alias("IATA"))
        .agg(F.count_distinct("flight_number", "scheduled_arrival_utc").alias("total_flights"))
        .orderBy(F.desc("total_flights"), "origin_airport", "IATA")
        .limit(k)
    )


def unique_departures(flights: DataFrame, iata: str | None = None) -> DataFrame:
    """Departures with one row per physical flight, the listing with the lowest flight number."""
    departures = at_airport(flights, iata, "origin").filter(F.col("movement_type") == DEPARTURE)
    ties = ["origin_name", "destination_name", "origin_country_code", "destination_country_code"]
    return first_per_key(
        departures,
        ["scheduled_departure_utc", "origin_iata", "destination_iata"],
        [F.asc_nulls_first("flight_number"), *[F.asc_nulls_first(c) for c in ties]],
    )


def flight_classification(flights: DataFrame, iata: str | None = None) -> DataFrame:
    """Each departing flight as Domestic or International; an unknown country is International.

    Flight number and destination end the order, so the sort also deals out one airport's rows over all tasks.
    """
    same_country = F.col("origin_country_code") == F.col("destination_country_code")
    return (
        unique_departures(flights, iata)
        .select(
            "flight_number",
            F.col("origin_name").alias("origin"),
            F.col("destination_name").alias("destination"),
            F.when(same_country, "Domestic").otherwise("International").alias("flight_type"),
        )
        .orderBy(F.desc("flight_type"), *[F.asc_nulls_first(c) for c in ["origin", "flight_number", "destination"]])
    )


def recent_arrivals(flights: DataFrame, iata: str | None = None, k: int = 5) -> DataFrame:
    """The ``k`` latest arrivals, one row per route and actual arrival time.

    Every distinct arrival time gives at least one row, so nothing earlier than the ``k``-th latest
    time can be in the answer. That time is found first and only the rows from it on are reduced to
    unique arrivals; when there are fewer than ``k`` times, all rows are, unknown times last.
    """
    arrivals = at_airport(flights, iata, "destination").filter(F.col("movement_type") == ARRIVAL)
    arrival_time = F.col("actual_arrival_utc")
    latest = (
        arrivals.filter(arrival_time.isNotNull())
        .select(arrival_time.alias("time"))
        .distinct()
        .orderBy(F.desc("time"))
        .limit(k)
        .agg(F.when(F.count("*") == k, F.min("time")).alias("cutoff"))
    )
    cutoff = latest.scalar()
    unique = first_per_key(
        arrivals.filter(cutoff.isNull() | (arrival_time >= cutoff)),
        ["actual_arrival_utc", "origin_iata", "destination_iata"],
        [F.asc_nulls_first("flight_number"), F.asc_nulls_first("origin_name"), F.asc_nulls_first("destination_name")],
    )
    return (
        unique.orderBy(
            arrival_time.desc_nulls_last(), F.asc_nulls_first("flight_number"),
            F.asc_nulls_first("origin_iata"), F.asc_nulls_first("destination_iata"),
        )
        .limit(k)
        .select(
            "flight_number",
            F.col("origin_name").alias("departure_airport"),
            F.col("destination_name").alias("origin_airport"),
            arrival_time.alias("arrival_time"),
        )
    )


def cancelled_flights(flights: DataFrame, airport: DataFrame, iata: str | None = None) -> DataFrame:
    """Cancelled flights between stored airports, newest first."""
    unique = first_per_key(
        at_airport(flights, iata, "origin").filter(F.col("status") == CANCELED),
        ["scheduled_departure_utc", "origin_iata", "destination_iata"],
        [F.asc_nulls_first("flight_number"), F.asc_nulls_first("aircraft_registration")],
    )
    named = {
        end: airport.select(F.col("iata_code").alias(f"{end}_iata"), F.col("name").alias(f"{end}_airport"))
        for end in ["origin", "destination"]
    }
    return (
        unique.join(named["origin"], "origin_iata")
        .join(named["destination"], "destination_iata")
        .select(
            "flight_number",
            F.col("aircraft_registration").alias("aircraft"),
            "origin_airport",
            "destination_airport",
            "scheduled_departure_utc",
        )
        .orderBy(F.desc_nulls_last("scheduled_departure_utc"))
    )


def delay_sources(flights: DataFrame, iata: str | None = None, min_flights: int = 2, k: int = 10) -> DataFrame:
    """The ``k`` origins with the largest share of late arrivals among those with more than
    ``min_flights`` distinct (flight number, scheduled arrival) pairs.

    Listings are reduced to one row per pair first, so two distinct counts need no row expansion.
    """
    pair = ["flight_number", "scheduled_arrival_utc"]
    late = F.col("actual_arrival_utc") > F.col("scheduled_arrival_utc")
    pairs = (
        at_airport(flights, iata, "destination")
        .filter((F.col("movement_type") == ARRIVAL) & (F.col("status") == ARRIVED))
        .groupBy(F.col("origin_name").alias("origin_airport"), F.col("origin_iata").alias("iata_code"), *pair)
        .agg(F.max(F.when(late, 1).otherwise(0)).alias("late"))
    )
    whole = F.col(pair[0]).isNotNull() & F.col(pair[1]).isNotNull()
    total = F.count_if(whole)
    return (
        pairs.groupBy("origin_airport", "iata_code")
        .agg(
            (F.sum(F.when(whole, F.col("late"))) * 100.0 / F.nullif(total, F.lit(0))).alias("percent_delayed"),
            total.alias("total_flights"),
        )
        .filter(F.col("total_flights") > min_flights)
        .orderBy(F.desc("percent_delayed"), "origin_airport", "iata_code")
        .limit(k)
    )
