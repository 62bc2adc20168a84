"""Finishing touches on report tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.selection import ALL
from skyloom.functions.text import named_code, percent_label

# Display column names, in the order of each report's columns.
DISPLAY_NAMES = {
    "cancelled_flights": [
        "Flight Numbers", "Aircraft Registration", "Origin Airport", "Destination Airport", "Scheduled Departure",
    ],
    "top_origins": ["Airport", "City", "Arriving Flights"],
    "recent_arrivals": ["Flight Numbers", "Departure From", "Arrival To", "Arrival Time"],
    "outbound_only_routes": [
        "Depature Airport", "Departure Airport IATA", "Arrival Airport", "Arrival Airport IATA",
    ],
    "classification_counts": ["Type", "Count"],
    "airline_performance": ["Airline Name", "airline_code_iata", "On-Time", "Delayed", "Cancelled"],
    "top_model_by_airline": ["Airline", "Most Used Model", "Flights"],
    "manufacturer_share": ["Aircraft Manufacturer", "Total Flights"],
    "models_by_manufacturer": ["Aircraft Model", "Total Flights"],
    "top_n_models": ["Aircraft Model", "Number of Flights"],
    "route_diversity": ["Origin Airport", "Destination Airport", "Unique Aircraft Models", "Routes"],
}

# Fill texts and labels.
NOT_AVAILABLE = "Not Available"
ALL_AIRPORTS = "All Airports (Global View)"
ROUTE_ARROW = " ➔ "


def with_percent_share(df: DataFrame, column: str, name: str = "Percentage") -> DataFrame:
    """Add ``column``'s share of its total as text. The total is one value computed beside the rows,
    so they are neither gathered in one task nor joined."""
    total = df.agg(F.sum(column)).scalar()
    return df.withColumn(name, percent_label(F.col(column) / total * 100))


def status_percentages(performance: DataFrame) -> DataFrame:
    """On-time, delayed and cancelled flights as percentages that sum to 100 per airline name."""
    parts = {"On-Time": "on_time_flights", "Delayed": "delayed_flights", "Cancelled": "cancelled_flights"}
    counts = performance.groupBy("airline_name").agg(*[F.sum(c).alias(c) for c in parts.values()])
    total = F.nullif(sum(F.col(c) for c in parts.values()), F.lit(0))
    return counts.select(
        F.col("airline_name").alias("Airline Name"),
        *[(F.col(c) * 100.0 / total).alias(label) for label, c in parts.items()],
    )


def classification_counts(classified: DataFrame) -> DataFrame:
    """Flights per type, most first."""
    counts = classified.groupBy("flight_type").agg(F.count("*").alias("n"))
    return counts.toDF("Type", "Count").orderBy(F.desc("Count"), "Type")


def top_n_models(usage: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most used models of ``model_usage``."""
    return usage.orderBy(F.desc("total_flights"), "aircraft_model").limit(n)


def route_label(df: DataFrame) -> DataFrame:
    """Add ``Route``, origin and destination joined by an arrow."""
    return df.withColumn("Route", F.concat("origin_name", F.lit(ROUTE_ARROW), "destination_name"))


def fill_display(df: DataFrame, text: str = "") -> DataFrame:
    """Every column as text, with ``text`` for NULL."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(text)).alias(c) for c in df.columns])


def display_names(df: DataFrame, names: Sequence[str] | str) -> DataFrame:
    """Rename all columns by position; a string names an entry of ``DISPLAY_NAMES``."""
    return df.toDF(*(DISPLAY_NAMES[names] if isinstance(names, str) else names))


def polyline_vertices(segments: DataFrame) -> DataFrame:
    """Each segment as three vertices: its start, its end and a break with no coordinates."""
    ends = [
        F.struct(F.col(f"{end}_lat").cast("double").alias("lat"), F.col(f"{end}_lon").cast("double").alias("lon"))
        for end in ["origin", "dest"]
    ]
    vertices = F.array(*ends, F.lit(None).cast("struct<lat: double, lon: double>"))
    return segments.select("*", F.posexplode(vertices).alias("vertex", "point")).select(
        *segments.columns, "vertex", "point.lat", "point.lon"
    )


def airport_labels(airports: DataFrame) -> DataFrame:
    """``name (code)`` to code for a selection list, the entry for all airports first.

    A repeated label keeps its first place and its last code.
    """
    listed = airports.select(
        named_code(F.col("name"), F.col("iata_code")).alias("label"),
        F.struct(F.lit(1).alias("place"), "name", "iata_code").alias("at"),
    )
    every = airports.sparkSession.range(1).select(
        F.lit(ALL_AIRPORTS).alias("label"),
        F.struct(
            F.lit(0).alias("place"), F.lit(None).cast("string").alias("name"), F.lit(ALL).alias("iata_code")
        ).alias("at"),
    )
    merged = every.unionByName(listed).groupBy("label").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return merged.orderBy("first").select("label", F.col("last.iata_code").alias("iata_code"))


def percent_text(df: DataFrame, column: str = "percent_delayed", name: str = "text") -> DataFrame:
    """Add a percentage column as text."""
    return df.withColumn(name, percent_label(F.col(column)))


def point_labels(destinations: DataFrame, origins: DataFrame, position: DataFrame, iata: str) -> DataFrame:
    """Labelled map points of one airport: where it flies to, what flies to it, and itself."""
    def points(df: DataFrame, label) -> DataFrame:
        return df.select(label.alias("label"), F.col("latitude"), F.col("longitude"))

    return (
        points(destinations, F.concat("name", F.lit(" (Destination)")))
        .unionByName(points(origins, F.concat("name", F.lit(" (Origin)"))))
        .unionByName(points(position, F.lit(f"{iata} (Selected)")))
    )
