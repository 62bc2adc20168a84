"""The as-of join against a brute-force version, and loads decided sync by sync."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from skyloom.operators.asof import as_of
from skyloom.plans.etl import run_etl
from skyloom.sources import feeds
from tests.test_etl import airport_doc, flight, leg


def brute_force(moments, states, or_first):
    out = set()
    for key, at in set(moments):
        own = sorted((s for s in states if s[0] == key), key=lambda s: (s[1] is not None, s[1] or 0, s[2]))
        before = [s for s in own if s[1] is None or (at is not None and s[1] <= at)]
        # Of the first time's states the last under the order.
        first = [s for s in own if s[1] == own[0][1]][-1:] if own and or_first else []
        hit = before[-1] if before else first[0] if first else None
        if key is not None:
            out.add((key, at, hit and hit[2:]))
    return out


@pytest.mark.parametrize("or_first", [False, True])
@pytest.mark.parametrize("ranges", [1, 3, 1000])
def test_against_brute_force(spark, or_first, ranges):
    random.seed(ranges)
    time = lambda: random.choice([None, *range(-20, 60)])
    # One key holds most rows.
    key = lambda: random.choice(["hot"] * 6 + ["a", "b", None])
    moments = [(key(), time()) for _ in range(200)] + [("none", 1)]
    states = [(key(), time(), i, f"v{i}") for i in range(60)] + [("late", 50, 99, None)] + [("late", 50, 100, "x")]
    moments += [("late", 3), ("late", 50), ("late", None)]
    got = as_of(spark.createDataFrame(moments * 2, "k string, t long").repartition(4),
                spark.createDataFrame(states, "k string, t long, n int, v string").repartition(4), "k", "t", ["n"], ["n", "v"],
                or_first, ranges)
    rows = [(r.k, r.t, r.state and tuple(r.state)) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_force(moments, states, or_first)


def test_empty_sides(spark):
    none, one = spark.createDataFrame([], "k string, t long, v int"), spark.createDataFrame([("a", 1, 1)], "k string, t long, v int")
    assert as_of(none, one, "k", "t", ["v"], ["v"]).collect() == []
    assert [r.state for r in as_of(one, none, "k", "t", ["v"], ["v"]).collect()] == [None]


def test_a_busy_key_is_sorted_in_many_tasks(spark):
    moments = spark.range(4000).selectExpr("'hot' AS k", "id AS t")
    states = spark.range(0, 4000, 50).selectExpr("'hot' AS k", "id AS t", "id AS v")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = as_of(moments, states, "k", "t", ["v"], ["v"])
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(sizes) >= 4 and max(sizes) < 2000
    assert found.filter("state.v <> t - t % 50").count() == 0


@pytest.fixture
def synced(spark, tmp_path):
    """LHR is accepted at sync 10, rejected at 20 and accepted again, renamed, at 30; CDG's only document is late."""
    docs = [airport_doc("LHR", ingest_seq=10, doc_id="a"), airport_doc("LHR", ingest_seq=20, doc_id="b", timeZone=...),
            airport_doc("LHR", ingest_seq=30, doc_id="c", fullName="Renamed"), airport_doc("CDG", ingest_seq=99, doc_id="d"),
            airport_doc("JFK", ingest_seq=1, doc_id="e", timeZone=...), airport_doc("IDL", ingest_seq=1, doc_id="f")]
    (tmp_path / "airports").mkdir()
    (tmp_path / "airports" / "all.json").write_text("\n".join(json.dumps(d) for d in docs))
    (tmp_path / "raw").mkdir()
    syncs = [("LHR", s) for s in (5, 10, 15, 20, 25, 30, 35)] + [("CDG", 15), ("JFK", 15), ("NON", 15)]
    lines = [json.dumps({"airport_iata": a, "ingest_seq": s, "doc_id": f"{a}{s}", "arrivals": [
        flight(f"{a}{s}", reg=f"R{a}{s}", arrival=leg(None, "2026-03-14 08:00Z"))]}) for a, s in syncs]
    (tmp_path / "raw" / "all.json").write_text("\n".join(lines))
    raw = spark.read.schema("airport_iata string, ingest_seq long, doc_id string, " + ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in feeds.FEED)).json(str(tmp_path / "raw"))
    feeds.archive_feed(raw, str(tmp_path / "flights"), syncs_per_folder=10)
    return str(tmp_path)


def test_each_sync_is_decided_by_its_own_document(spark, synced, tmp_path):
    loaded = run_etl(spark, synced, str(tmp_path / "tables"))
    # Sync 5 lies before the first document and goes with it; 20 and 25 go with the rejected one.
    assert sorted(r.flight_number for r in loaded.flights.collect()) == ["CDG15", "LHR10", "LHR15", "LHR30", "LHR35", "LHR5"]
    assert {r.aircraft_registration for r in loaded.aircraft.collect()} == {
        "RCDG15", "RLHR10", "RLHR15", "RLHR30", "RLHR35", "RLHR5"}
    assert sorted((r.iata_code, r.name) for r in loaded.airport.collect()) == [("CDG", "CDG Field"), ("LHR", "Renamed")]
    assert sorted((r.iata_code, r.reason) for r in loaded.skipped.collect()) == [
        ("IDL", "no flight data"), ("JFK", "missing: timezone"), ("LHR", "missing: timezone")]


def test_a_window_before_the_rename_loads_the_older_document(spark, synced, tmp_path):
    loaded = run_etl(spark, synced, str(tmp_path / "tables"), airports=["LHR"], since=10, until=20)
    assert sorted(r.flight_number for r in loaded.flights.collect()) == ["LHR10", "LHR15"]
    assert [r.name for r in loaded.airport.collect()] == ["LHR Field"]


def _files_read(df):
    """Files that the scan opened, by its own metric; the plan's text."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    scan = scan.executedPlan().collectLeaves().head() if "Adaptive" in scan.getClass().getName() else scan
    return scan.metrics().apply("numFiles").value(), plan.toString()


def test_an_archive_opens_only_chosen_folders(spark, synced):
    path = f"{synced}/flights"
    everything, _ = _files_read(feeds.read_flight_feed(spark, path))
    chosen, text = _files_read(feeds.read_flight_feed(spark, path, airports=["LHR"], since=20, until=29))
    assert everything == 7 and chosen == 1
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", text)[1]
    assert "airport_iata" in filters and "sync_to" in filters and "sync_from" in filters
    assert [r.ingest_seq for r in feeds.read_flight_feed(spark, path, since=21, until=29).collect()] == [25]
    assert feeds.read_flight_feed(spark, path, airports=[]).count() == 0


def test_raw_documents_are_chosen_by_file_name(spark, tmp_path):
    for iata in ("LHR", "LHRX", "CDG"):
        (tmp_path / f"flight_data_{iata}.json").write_text(json.dumps({"arrivals": [flight("A1")]}))
    read = lambda **k: feeds.read_flight_feed(spark, str(tmp_path), multi_line=True, **k)
    assert [r.airport_iata for r in read(airports=["LHR"]).collect()] == ["LHR"]
    assert _files_read(read(airports=["CDG"]))[0] == 1 and read(airports=["%"]).count() == 0
