"""Reports on routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions.selection import is_all
from skyloom.plans.operations import unique_departures


def outbound_only_routes(flights: DataFrame, iata: str | None = None) -> DataFrame:
    """Routes that nobody flies back.

    For all airports: every route with a known origin and no flight the other way; an unknown
    destination stays. For one airport: its routes to places that never fly to it; an unknown
    destination stays only if nothing flies to it at all, as under SQL's NOT IN.
    """
    result = _unreturned(flights) if is_all(iata) else _unreturned_from(flights, iata)
    return result.select(
        "origin_name",
        F.col("origin_iata").alias("origin_airport_code"),
        "destination_name",
        F.col("destination_iata").alias("destination_airport_code"),
    ).orderBy("destination_name", "origin_name", "origin_airport_code", "destination_airport_code")


def _routes(flights: DataFrame) -> DataFrame:
    return flights.select("origin_name", "origin_iata", "destination_name", "destination_iata").distinct()


def _unreturned(flights: DataFrame) -> DataFrame:
    """One pass over the flights: distinct routes, then both directions of a pair side by side."""
    origin, destination = F.col("origin_iata"), F.col("destination_iata")
    routes = _routes(flights.filter(origin.isNotNull())).withColumns({
        "low": F.least(origin, destination),
        "high": F.when(destination.isNotNull(), F.greatest(origin, destination)),
    })
    pair = Window.partitionBy("low", "high")
    flies = {end: F.max(origin == F.col(end)).over(pair) for end in ["low", "high"]}
    returned = F.when(origin == F.col("low"), flies["high"]).otherwise(flies["low"])
    return routes.withColumn("returned", destination.isNotNull() & returned).filter("NOT returned")


def _unreturned_from(flights: DataFrame, iata: str) -> DataFrame:
    outbound = _routes(flights.filter(F.col("origin_iata") == F.lit(iata)))
    inbound = flights.filter((F.col("destination_iata") == F.lit(iata)) & F.col("origin_iata").isNotNull())
    sources = inbound.select(F.col("origin_iata").alias("destination_iata")).distinct()
    return outbound.join(sources, "destination_iata", "left_anti").filter(
        F.col("destination_iata").isNotNull() | ~inbound.exists()
    )


def route_diversity(
    flights: DataFrame, aircraft: DataFrame, iata: str | None = None, min_models: int = 2
) -> DataFrame:
    """City pairs served by more than ``min_models`` aircraft models, found by flight number.

    Both sides are reduced to distinct pairs before they meet, so a flight number shared by many
    listings or many aircraft meets each route and each model once.
    """
    served = unique_departures(flights, iata).select("origin_name", "destination_name", "flight_number").distinct()
    flown = aircraft.select("flight_number", "aircraft_model").distinct()
    return (
        served.join(flown, "flight_number")
        .groupBy("origin_name", "destination_name")
        .agg(F.count_distinct("aircraft_model").alias("aircraft_model_count"))
        .filter(F.col("aircraft_model_count") > min_models)
        .orderBy(F.desc("aircraft_model_count"), "origin_name", "destination_name")
    )
