"""Airports and the data behind the route maps.

Flights are reduced to distinct or counted airport codes before any join, so the joins with the
airport table handle a few rows per airport pair whatever the number of flights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def airport_list(airport: DataFrame) -> DataFrame:
    """Code, name and city of every airport, by name."""
    return airport.select("iata_code", "name", "city").orderBy("name", "iata_code")


def has_data(airport: DataFrame) -> bool:
    """Whether any airport is stored."""
    return not airport.isEmpty()


def data_present(airport: DataFrame) -> DataFrame:
    """``has_data`` as a one-row DataFrame."""
    return airport.limit(1).agg((F.count("*") > 0).alias("has_data"))


def _position(airport: DataFrame, prefix: str) -> DataFrame:
    return airport.select(
        F.col("iata_code").alias(f"{prefix}_iata"),
        F.col("latitude").alias(f"{prefix}_lat"),
        F.col("longitude").alias(f"{prefix}_lon"),
    )


def route_segments(flights: DataFrame, airport: DataFrame) -> DataFrame:
    """Distinct pairs of end coordinates over all flights between stored airports."""
    pairs = flights.select("origin_iata", F.col("destination_iata").alias("dest_iata")).dropna().distinct()
    return (
        pairs.join(_position(airport, "origin"), "origin_iata")
        .join(_position(airport, "dest"), "dest_iata")
        .select("origin_lat", "origin_lon", "dest_lat", "dest_lon")
        .distinct()
    )


def active_airports(flights: DataFrame, airport: DataFrame) -> DataFrame:
    """Stored airports at either end of any flight."""
    codes = flights.select(F.explode(F.array("origin_iata", "destination_iata")).alias("iata_code")).dropna().distinct()
    return airport.join(codes, "iata_code", "left_semi").select("name", "latitude", "longitude").distinct()


def airport_position(airport: DataFrame, iata: str) -> DataFrame:
    """Coordinates of one airport; (0, 0) when it is not stored."""
    return airport.filter(F.col("iata_code") == F.lit(iata)).agg(
        F.coalesce(F.max("latitude"), F.lit(0).cast("decimal(10,8)")).alias("latitude"),
        F.coalesce(F.max("longitude"), F.lit(0).cast("decimal(11,8)")).alias("longitude"),
    )


def outbound_destinations(flights: DataFrame, airport: DataFrame, iata: str) -> DataFrame:
    """Stored airports that ``iata`` flies to, with the number of numbered listings."""
    return _partners(flights, airport, iata, "origin_iata", "destination_iata")


def inbound_origins(flights: DataFrame, airport: DataFrame, iata: str) -> DataFrame:
    """Stored airports that fly to ``iata``, with the number of numbered listings."""
    return _partners(flights, airport, iata, "destination_iata", "origin_iata")


def _partners(flights: DataFrame, airport: DataFrame, iata: str, own: str, other: str) -> DataFrame:
    counts = (
        flights.filter(F.col(own) == F.lit(iata))
        .groupBy(F.col(other).alias("iata_code"))
        .agg(F.count("flight_number").alias("n"))
    )
    return (
        counts.join(airport.select("iata_code", "name", "latitude", "longitude"), "iata_code")
        .groupBy("name", "latitude", "longitude")
        .agg(F.sum("n").alias("count"))
    )


def airport_segments(partners: DataFrame, position: DataFrame) -> DataFrame:
    """Segments from one airport's position to each of its partners, shaped like ``route_segments``.

    ``route`` is the partner's name, which tells apart two partners in one place.
    """
    anchor = position.select(F.struct("latitude", "longitude")).scalar()
    return partners.withColumn("anchor", anchor).select(
        F.col("name").alias("route"),
        F.col("anchor.latitude").alias("origin_lat"),
        F.col("anchor.longitude").alias("origin_lon"),
        F.col("latitude").alias("dest_lat"),
        F.col("longitude").alias("dest_lon"),
    )
