"""Hand-written rows: everything not given is NULL."""

from __future__ import annotations

import datetime
from decimal import Decimal

from skyloom.schemas import AIRCRAFT, AIRPORT, FLIGHTS


def at(text: str) -> datetime.datetime:
    """``"14 08:00"`` as 14 March 2026, 08:00."""
    return datetime.datetime.strptime(f"2026-03-{text}", "%Y-%m-%d %H:%M")


def _frame(spark, schema, rows):
    names = schema.names
    for row in rows:
        assert set(row) <= set(names), set(row) - set(names)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def flights(spark, *rows):
    return _frame(spark, FLIGHTS, rows)


def aircraft(spark, *rows):
    return _frame(spark, AIRCRAFT, rows)


def airports(spark, *rows):
    numbers = [{k: Decimal(str(v)) if k in ("latitude", "longitude") else v for k, v in row.items()} for row in rows]
    return _frame(spark, AIRPORT, numbers)


def arrival(origin, destination, **more):
    return {
        "movement_type": "Arrival", "origin_iata": origin, "destination_iata": destination,
        "origin_name": origin and f"{origin} City", "destination_name": destination and f"{destination} City", **more,
    }


def departure(origin, destination, **more):
    return {**arrival(origin, destination), "movement_type": "Departure", **more}


def tuples(df):
    return [tuple(row) for row in df.collect()]
