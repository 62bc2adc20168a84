"""Reports on aircraft, manufacturers and models.

Flights are counted per registration before they meet the aircraft table. The count is combined on the
map side, so a registration that holds most rows costs one row per task, and the join moves at most
one row per aircraft.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.selection import at_airport
from skyloom.operators.dedupe import first_per_key

_REGISTRATION = "aircraft_registration"


def _counted(flights: DataFrame) -> DataFrame:
    return flights.filter(F.col(_REGISTRATION).isNotNull()).groupBy(_REGISTRATION).agg(F.count("*").alias("n"))


def _total_by(counts: DataFrame, aircraft: DataFrame, *groups: str) -> DataFrame:
    wanted = aircraft.select(*dict.fromkeys([_REGISTRATION, *groups]))
    return counts.join(wanted, _REGISTRATION).groupBy(*groups).agg(F.sum("n").alias("total_flights"))


def _physical_flights(flights: DataFrame) -> DataFrame:
    """One row per departure time and route, with the lowest registration of its listings."""
    return flights.groupBy("scheduled_departure_utc", "origin_iata", "destination_iata").agg(
        F.min(_REGISTRATION).alias(_REGISTRATION)
    )


def manufacturer_share(flights: DataFrame, aircraft: DataFrame, iata: str | None = None) -> DataFrame:
    """Stored flights per manufacturer, most first."""
    counts = _counted(at_airport(flights, iata, "origin", "destination"))
    return _total_by(counts, aircraft, "aircraft_manufacturer").orderBy(
        F.desc("total_flights"), "aircraft_manufacturer"
    )


def models_by_manufacturer(
    flights: DataFrame, aircraft: DataFrame, manufacturer: str, iata: str | None = None
) -> DataFrame:
    """Stored flights per model of one manufacturer, most first."""
    counts = _counted(at_airport(flights, iata, "origin", "destination"))
    made = aircraft.filter(F.col("aircraft_manufacturer") == F.lit(manufacturer))
    return _total_by(counts, made, "aircraft_model").orderBy(F.desc("total_flights"), "aircraft_model")


def model_usage(flights: DataFrame, aircraft: DataFrame, iata: str | None = None) -> DataFrame:
    """Physical flights per model, most first."""
    counts = _counted(_physical_flights(at_airport(flights, iata, "origin", "destination")))
    return _total_by(counts, aircraft, "aircraft_model").orderBy(F.desc("total_flights"), "aircraft_model")


def busy_aircraft(flights: DataFrame, aircraft: DataFrame, min_flights: int = 5) -> DataFrame:
    """Aircraft with more than ``min_flights`` physical flights, busiest first."""
    counts = _counted(_physical_flights(flights))
    return (
        _total_by(counts, aircraft, _REGISTRATION, "aircraft_model")
        .filter(F.col("total_flights") > min_flights)
        .orderBy(F.desc("total_flights"), _REGISTRATION)
    )


def top_model_by_airline(flights: DataFrame, aircraft: DataFrame) -> DataFrame:
    """Each airline's most used model; the alphabetically first of equals."""
    named = aircraft.filter(F.col("airline_name").isNotNull() & F.col("aircraft_model").isNotNull())
    usage = _total_by(_counted(flights), named, "airline_name", "aircraft_model")
    order = [F.desc("total_flights"), F.asc("aircraft_model")]
    return (
        first_per_key(usage, ["airline_name"], order)
        .withColumnRenamed("total_flights", "flight_count")
        .orderBy("airline_name")
    )
