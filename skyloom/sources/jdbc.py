"""The stored tables in a relational database, for those who keep them there.

Needs the database's JDBC driver on the class path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from skyloom.schemas import TABLES
from skyloom.sources.tables import FlightTables


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    properties: Mapping[str, str],
    predicates: Mapping[str, Sequence[str]] | None = None,
) -> FlightTables:
    """The four tables; ``predicates`` (by table, one SQL condition per partition, together covering every
    row once) let the executors read a table side by side instead of through one connection."""
    frames = {}
    for name, schema in TABLES.items():
        parts = list((predicates or {}).get(name, [])) or None
        frame = spark.read.jdbc(url, name, predicates=parts, properties={**properties, "preferTimestampNTZ": "true"})
        frames[name] = frame.select(*schema.names)
    return FlightTables(**frames)


def append_jdbc(
    df: DataFrame, url: str, table: str, properties: Mapping[str, str], batch_size: int = 500, connections: int = 16
) -> None:
    """Append rows in batches over ``connections`` connections. A shuffle before them keeps the plan above parallel."""
    df.repartition(connections).write.option("batchsize", batch_size).jdbc(
        url, table, mode="append", properties=dict(properties)
    )
