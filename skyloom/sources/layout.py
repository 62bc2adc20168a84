"""A copy of ``flights`` laid out so that a report at one airport reads little of it.

Reports at an airport want flights with the airport at either end, so neither end alone can be the order of the files. Codes of
both ends are cut into ranges of about equal numbers of flights, and rows are sorted by the two ranges' numbers with their
bits interleaved: rows that lie near each other are alike in both ends. Each row group then spans few codes of either, and the
minima and maxima that Parquet keeps for it, with Bloom filters for what these let pass, tell Spark's reader which to skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.schemas import FLIGHTS

#: Ranges of codes for each end, a power of two.
RANGES = 64
#: Codes that a Bloom filter is laid out for; there are some ten thousand airports with an IATA code.
CODES = 20_000
ENDS = ["origin_iata", "destination_iata"]


def code_ranges(flights: DataFrame, ranges: int = RANGES) -> DataFrame:
    """``code, range``: the codes of both ends, cut so that each range has about as many flights as any other.

    Flights are counted by code first; the running sum is over one row per airport.
    """
    counts = flights.select(F.explode(F.array(*ENDS)).alias("code")).filter("code IS NOT NULL").groupBy("code").agg(
        F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("code", F.floor(before * ranges / total).cast("int").alias("range"))


def interleaved(a: Column, b: Column, bits: int) -> Column:
    """The bits of ``a`` and ``b`` in turn, the highest first."""
    value = F.lit(0)
    for bit in range(bits):
        for shift, number in ((2 * bit + 1, a), (2 * bit, b)):
            value = value.bitwiseOR(F.shiftleft(F.shiftright(number, bit).bitwiseAND(F.lit(1)), shift))
    return value


def write_clustered(flights: DataFrame, path: str, ranges: int = RANGES, row_group_bytes: int = 16 << 20, mode: str = "errorifexists") -> None:
    """Write ``flights`` to ``path``, clustered by both ends. The departure time comes last in the order, so that a pair of
    airports with a large share of all flights is split over several tasks and files."""
    known = code_ranges(flights, ranges)
    placed = flights.select(*FLIGHTS.names)
    for end in ENDS:
        placed = placed.join(known.select(F.col("code").alias(end), F.col("range").alias(f"{end}_range")), end, "left")
    near = interleaved(*[F.coalesce(F.col(f"{end}_range"), F.lit(0)) for end in ENDS], max(ranges - 1, 1).bit_length())
    order = ["near", *ENDS, "scheduled_departure_utc"]
    writer = placed.withColumn("near", near).repartitionByRange(*order).sortWithinPartitions(*order).select(*FLIGHTS.names).write.mode(
        mode).option("parquet.block.size", row_group_bytes)
    for end in ENDS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{end}", "true").option(f"parquet.bloom.filter.expected.ndv#{end}", CODES)
    writer.parquet(path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    """The flights that ``write_clustered`` stored."""
    return spark.read.schema(FLIGHTS).parquet(path)
