"""The clustered copy of the flights: same rows, far fewer of them read for one airport."""

import pytest
from pyspark.sql import functions as F

from skyloom.functions.selection import at_airport
from skyloom.plans import operations
from skyloom.schemas import FLIGHTS
from skyloom.sources import layout
from tests.rows import tuples


@pytest.fixture(scope="module")
def even(spark):
    """60 airports, every pair equally often, in no order."""
    flights = spark.range(180_000).select(F.pmod(F.xxhash64("id"), F.lit(60)).alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(60)).alias("b"), "id")
    made = {"origin_iata": F.format_string("A%02d", "a"), "destination_iata": F.format_string("A%02d", "b"), "movement_type": F.lit("Departure"),
            "flight_number": F.concat(F.lit("F"), "id"), "origin_name": F.lit("x"), "destination_name": F.lit("y"),
            "scheduled_departure_utc": F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, int(id % 50000))")}
    return flights.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FLIGHTS])


def rows_read(df):
    """Rows of the row groups and pages that the scan did not skip, by its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    scan = scan.executedPlan().collectLeaves().head() if "Adaptive" in scan.getClass().getName() else scan
    return scan.metrics().apply("numOutputRows").value()


def test_one_airport_reads_a_fifth_or_less(spark, even, tmp_path):
    clustered, plain = str(tmp_path / "clustered"), str(tmp_path / "plain")
    layout.write_clustered(even, clustered, row_group_bytes=1 << 15)
    even.repartition(8).write.option("parquet.block.size", 1 << 15).parquet(plain)
    for iata in ("A07", "A59"):
        chosen = at_airport(layout.read_clustered(spark, clustered), iata, "origin", "destination")
        same = at_airport(spark.read.schema(FLIGHTS).parquet(plain), iata, "origin", "destination")
        assert chosen.count() == same.count() > 5000
        assert 5 * rows_read(chosen) <= rows_read(same) <= 180_000


def test_the_copy_has_the_same_rows_and_reports(spark, even, tmp_path):
    odd = even.limit(300).withColumn("origin_iata", F.when(F.col("flight_number") != "F3", F.col("origin_iata"))).unionByName(even.limit(5))
    odd.write.parquet(str(tmp_path / "odd"))
    odd = spark.read.schema(FLIGHTS).parquet(str(tmp_path / "odd"))
    layout.write_clustered(odd, str(tmp_path / "copy"))
    copy = layout.read_clustered(spark, str(tmp_path / "copy"))
    assert sorted(map(str, tuples(copy))) == sorted(map(str, tuples(odd)))
    for report in (lambda f: operations.top_origins(f, "A07"), lambda f: operations.flight_classification(f, "A07")):
        assert sorted(map(str, tuples(report(copy)))) == sorted(map(str, tuples(report(odd))))
    layout.write_clustered(odd.limit(0), str(tmp_path / "none"))
    assert layout.read_clustered(spark, str(tmp_path / "none")).count() == 0


def test_a_busy_pair_is_split_over_files(spark, tmp_path):
    made = {"origin_iata": F.lit("AAA"), "destination_iata": F.lit("BBB"),
            "scheduled_departure_utc": F.expr("timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, int(id))")}
    busy = spark.range(20_000).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FLIGHTS])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        layout.write_clustered(busy, str(tmp_path / "busy"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in layout.read_clustered(spark, str(tmp_path / "busy")).groupBy("_metadata.file_path").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 5000


def test_bits_are_interleaved(spark):
    df = spark.createDataFrame([(0b101, 0b011)], "a int, b int")
    assert df.select(layout.interleaved(F.col("a"), F.col("b"), 3)).first()[0] == 0b100111
