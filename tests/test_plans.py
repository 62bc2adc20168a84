"""What the plans must look like to hold at size, with broadcasting switched off."""

import re

import pytest
from pyspark.sql import functions as F

from skyloom.operators import airports as A
from skyloom.operators import delays as D
from skyloom.operators import movements as M
from skyloom.plans import fleet, operations, routes
from skyloom.sources import tables
from tests.rows import at, departure, flights
from workload import registry
from workload import tables as T

SF = "/root/testdata/sf0.001"
REPORTS = [name for name in registry.QUERIES if name[0] in "rp"]
STEPS = [name for name in registry.QUERIES if name[0] in "ts"]


@pytest.fixture
def big(spark):
    """Plans as for tables too large to send out."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", REPORTS + STEPS)
def test_no_nested_loops_no_python_no_single_partition_rows(big, name):
    text = plan(registry.QUERIES[name](big, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    # Only global aggregates and one-row limits may meet in one partition, after reducing on the map side.
    for below in re.findall(r"Exchange SinglePartition[^\n]*\n([^\n]*)", text):
        assert "partial_" in below or "LocalLimit 1" in below or "HashAggregate" in below, below


@pytest.mark.parametrize("build", [
    lambda f: operations.unique_departures(f),
    lambda f: operations.cancelled_flights(f, f.selectExpr("origin_iata AS iata_code", "origin_name AS name")),
    lambda f: operations.recent_arrivals(f),
])
def test_first_row_is_limited_before_the_shuffle(big, build):
    text = plan(build(T.flights(big, SF)))
    window, after = text.split("WindowGroupLimit", 1)
    assert "Final" in after.split("\n")[0]
    assert re.search(r"Exchange hashpartitioning[^\n]*\n[^\n]*WindowGroupLimit[^\n]*Partial", text)


def test_one_airport_sorts_in_many_tasks(big):
    rows = big.range(4000).selectExpr(
        "'F' || id AS flight_number", "'AAA' AS origin_iata", "'One' AS origin_name", "'x' AS origin_country_code",
        "'BBB' AS destination_iata", "'Two' AS destination_name", "'x' AS destination_country_code", "'Departure' AS movement_type",
        "timestamp_ntz'2026-01-01' + make_dt_interval(0, 0, int(id)) AS scheduled_departure_utc")
    big.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = operations.flight_classification(rows, "AAA").groupBy(F.spark_partition_id()).count().collect()
    finally:
        big.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) == 8


def test_delays_are_dealt_out_by_time_in_two_shuffles(big, tmp_path):
    M.clean_movements(T.feed(big, SF), A.airport_defaults(big)).write.parquet(str(tmp_path / "cleaned"))
    text = plan(D.daily_delays(big.read.parquet(str(tmp_path / "cleaned"))))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert len(exchanges) == 2, text
    assert "sched_time" in exchanges[1] and text.rindex("isnotnull(scheduled_arrival_utc") > text.index("Window")


def test_route_names_are_shuffled_once(big):
    text = plan(operations.frequent_routes(T.flights(big, SF)))
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        assert keys.count("origin_name") <= 1


def test_flights_are_counted_before_they_meet_aircraft(big):
    text = plan(fleet.manufacturer_share(T.flights(big, SF), T.aircraft(big, SF)))
    join = text.index("SortMergeJoin")
    assert "count(1)" in text[join:] and "partial_count(1)" in text[join:]


def test_filters_and_columns_reach_the_scan(big, tmp_path):
    root = str(tmp_path / "tables")
    tables.create_tables(big, root)
    tables.append_flights(flights(big, departure("AAA", "BBB", scheduled_departure_utc=at("14 08:00"))), root)
    stored = tables.read_tables(big, root).flights
    text = plan(routes.outbound_only_routes(stored, "AAA"))
    assert "EqualTo(origin_iata,AAA)" in text
    scanned = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert scanned and all("scheduled" not in s and "flight_number" not in s for s in scanned)


def test_generated_methods_stay_compilable(spark):
    """The JVM leaves methods over 8000 bytes to its interpreter; the cleaning must not grow past that."""
    path = registry.shared_dir(spark, "feed")
    registry.feeds.archive_feed(T.feed(spark, SF), path)
    feed = registry.feeds.read_flight_feed(spark, path)
    cleaned = M.clean_movements(feed, A.airport_defaults(spark))
    for df in [
        M.build_flights(cleaned), M.build_aircraft(cleaned),
        D.daily_delays(cleaned),
    ]:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            executed = df.select("*")._jdf.queryExecution().executedPlan()
            stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(executed)
            sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        assert sizes and max(sizes) < 8000, sizes


def test_the_feeds_generated_methods_stay_compilable(spark):
    """Also in a session that keeps long methods fused, as Spark does unless told otherwise."""
    limit = spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    try:
        executed = T.feed(spark, SF).repartition(8, "airport_iata")._jdf.queryExecution().executedPlan()
        stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(executed)
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", limit)
    assert sizes and max(sizes) < 8000, sizes
