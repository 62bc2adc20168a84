"""The airport selection that the reports share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: the selection that means every airport.
ALL = "ALL"


def is_all(iata: str | None) -> bool:
    """Whether ``iata`` selects every airport."""
    return iata is None or iata == ALL


def at_airport(flights: DataFrame, iata: str | None, *ends: str) -> DataFrame:
    """``flights`` with the selected airport at one of the ``ends`` (``origin``, ``destination``)."""
    if is_all(iata):
        return flights
    chosen = F.lit(False)
    for end in ends:
        chosen = chosen | (F.col(f"{end}_iata") == F.lit(iata))
    return flights.filter(chosen)
