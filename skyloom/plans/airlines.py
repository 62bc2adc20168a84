"""Reports on airlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.selection import at_airport
from skyloom.operators.dedupe import first_per_key
from skyloom.plans.operations import ARRIVAL, ARRIVED, CANCELED, DELAYED


def airline_performance(flights: DataFrame, aircraft: DataFrame, iata: str | None = None) -> DataFrame:
    """On-time, delayed and cancelled arrivals per airline, most on time first.

    Listings of one flight count once, by the latest actual arrival. A flight marked Delayed that came
    in on time counts on both sides, one marked Arrived without an arrival time on neither. Counts are
    made per airline code; a code with several names shows them under each.
    """
    unique = first_per_key(
        at_airport(flights, iata, "destination").filter(
            (F.col("movement_type") == ARRIVAL) & F.col("status").isin(ARRIVED, CANCELED, DELAYED)
        ),
        ["scheduled_arrival_utc", "origin_iata", "destination_iata"],
        [
            F.desc_nulls_last("actual_arrival_utc"),
            *[F.asc_nulls_first(c) for c in ["flight_number", "airline_code_iata", "status"]],
        ],
    )
    flown = F.col("status") != CANCELED
    on_time = F.col("actual_arrival_utc") <= F.col("scheduled_arrival_utc")
    late = F.col("actual_arrival_utc") > F.col("scheduled_arrival_utc")
    per_code = unique.groupBy("airline_code_iata").agg(
        F.count_if(flown & on_time).alias("on_time_flights"),
        F.count_if(flown & ((F.col("status") == DELAYED) | late)).alias("delayed_flights"),
        F.count_if(~flown).alias("cancelled_flights"),
    )
    names = aircraft.select("airline_code_iata", "airline_name").distinct()
    return (
        per_code.join(names, "airline_code_iata")
        .select("airline_name", "airline_code_iata", "on_time_flights", "delayed_flights", "cancelled_flights")
        .orderBy(F.desc("on_time_flights"), "airline_name", "airline_code_iata")
    )
