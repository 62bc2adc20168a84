"""Stored tables: versions, loads that count, replaced syncs, compaction, buckets and the catalog."""

import re
import time

import pytest
from pyspark.sql import functions as F

from skyloom.operators import airports as A
from skyloom.operators.components import components
from skyloom.plans import etl
from skyloom.plans.etl import run_etl
from skyloom.schemas import AIRCRAFT, AIRPORT, FLIGHTS
from skyloom.session import shared_dir
from skyloom.sources import feeds, ledger, tables, versions
from tests.rows import at
from tests.test_asof import synced  # noqa: F401
from tests.test_upsert import SCHEMA, check, modelled


def airports(spark, *rows):
    return spark.createDataFrame([(1, f"{i}", icao, iata, name, *[None] * 6) for i, (icao, iata, name) in enumerate(rows)], SCHEMA)


def names(spark, root):
    return sorted((r.iata_code, r.name) for r in tables.read_tables(spark, root).airport.collect())


def test_of_two_loads_at_once_one_starts_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    upsert, calls = tables.upsert_airports, []

    def slow(existing, incoming):
        """While the first load works on version 1, another one commits version 2."""
        calls.append(existing.count())
        if len(calls) == 1:
            tables.load_airports(airports(spark, ("KB", "B", "fast"), ("KC", "C", "fast")), root)
        return upsert(existing, incoming)

    monkeypatch.setattr(tables, "upsert_airports", slow)
    tables.load_airports(airports(spark, ("KA", "A", "slow"), ("KB", "B", "slow")), root)
    # The slow load saw an empty table, lost, and went on from the fast one's two rows: nothing is lost or doubled.
    assert calls == [0, 0, 2]
    assert names(spark, root) == [("A", "slow"), ("B", "slow"), ("C", "fast")]


def test_a_commit_over_another_fails_and_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    df = spark.range(3)
    versions.commit(df, path, 0)
    with pytest.raises(versions.Conflict):
        versions.commit(df, path, 0)
    assert versions.versions(spark, path) == [1]
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v")]) == 1
    assert [p.name for p in (tmp_path / "table" / "_commits").iterdir() if p.name[0] != "."] == [f"{1:020d}.json"]
    with pytest.raises(versions.Conflict):
        versions.replace(spark, path, df.schema, lambda rows: (versions.commit(df, path, versions.versions(spark, path)[-1]), rows)[1], attempts=2)


def test_old_versions_go(spark, tmp_path):
    path = str(tmp_path / "table")
    for n in range(6):
        versions.replace(spark, path, spark.range(1).schema, lambda rows, n=n: spark.range(n + 1), keep=2)
    assert versions.versions(spark, path) == [5, 6]
    assert len([p for p in (tmp_path / "table").iterdir() if p.name.startswith("v")]) == 2
    assert versions.read(spark, path, spark.range(1).schema).count() == 6
    # A folder that no entry names is left alone while it is young.
    spark.range(1).write.parquet(f"{path}/v9-left")
    assert versions.retain(spark, path, 2) == [] and versions.retain(spark, path, 2, orphan_hours=-1) == ["v9-left"]


def writes_of(monkeypatch, spark, rows):
    made = []
    monkeypatch.setattr(A, "materialise", lambda df, real=A.materialise: (made.append(1), real(df))[1])
    check(spark, [], rows)
    monkeypatch.undo()
    return len(made)


def test_a_long_chain_takes_as_many_writes_as_a_short_one(spark, monkeypatch):
    def chain(n):
        """Each pair shares its ICAO code with one neighbour and its IATA code with the other."""
        return [(f"K{(i + 1) // 2}", f"A{i // 2}", f"n{i}") for i in range(n)]

    assert modelled([], chain(200)) is not None
    assert writes_of(monkeypatch, spark, chain(200)) == writes_of(monkeypatch, spark, chain(2))
    check(spark, [], [(f"K{i // 2}", f"A{(i + 1) // 2}", f"n{i}") for i in range(60)])


@pytest.mark.parametrize("one_task", [1000, 0])
def test_components_against_union_find(spark, one_task):
    import random

    random.seed(4)
    edges = [(f"n{random.randrange(60)}", f"n{random.randrange(60)}") for _ in range(35)] + [("x", "x"), ("p1", "p2"), ("p2", "p3")]
    own = {n: n for e in edges for n in e}
    for _ in own:
        for a, b in edges:
            own[a] = own[b] = min(own[a], own[b])
    got = components(spark.createDataFrame(edges, "a string, b string").repartition(4), one_task).collect()
    assert len(got) == len(own) and {r.node: r.component for r in got} == own


def loaded(tables_read):
    return sorted(r.flight_number for r in tables_read.flights.collect())


def test_a_repeated_sync_is_stored_again_replaced_or_left(spark, synced, tmp_path):  # noqa: F811
    root = str(tmp_path / "tables")
    first = loaded(run_etl(spark, synced, root))
    delays = tables.read_tables(spark, root).airport_delays.count()
    assert loaded(run_etl(spark, synced, root, repeat="skip")) == first
    assert loaded(run_etl(spark, synced, root, repeat="replace")) == first
    assert tables.read_tables(spark, root).airport_delays.count() == delays
    assert loaded(run_etl(spark, synced, root, airports=["CDG"])) == sorted(first + ["CDG15"])
    # Both copies of the sync are replaced by one.
    assert loaded(run_etl(spark, synced, root, airports=["CDG"], repeat="replace")) == first
    assert tables.read_tables(spark, root).airport_delays.count() == delays
    with pytest.raises(ValueError):
        run_etl(spark, synced, root, repeat="other")


def test_a_load_that_breaks_off_is_never_seen(spark, synced, tmp_path, monkeypatch):  # noqa: F811
    root = str(tmp_path / "tables")
    first = loaded(run_etl(spark, synced, root))

    def broken(*_, **__):
        raise RuntimeError("executor lost")

    for name in ("append_delays", "append_flights"):
        monkeypatch.setattr(etl, name, broken)
        with pytest.raises(RuntimeError):
            run_etl(spark, synced, root, repeat="replace")
        assert loaded(tables.read_tables(spark, root)) == first
        monkeypatch.undo()
    assert loaded(run_etl(spark, synced, root, repeat="replace")) == first


def test_a_replaced_sync_takes_its_new_rows(spark, synced, tmp_path):  # noqa: F811
    root = str(tmp_path / "tables")
    run_etl(spark, synced, root)
    feed = feeds.read_flight_feed(spark, f"{synced}/flights", airports=["LHR"], since=10, until=15).withColumn(
        "arrivals", F.expr("transform(arrivals, a -> named_struct('number', 'new', 'status', a.status, 'departure', a.departure, "
                           "'arrival', a.arrival, 'movement', a.movement, 'aircraft', a.aircraft, 'airline', a.airline))"))
    docs = feeds.read_airport_feed(spark, f"{synced}/airports")
    assert loaded(etl.load_feed(feed, docs, root, repeat="replace")) == ["CDG15", "LHR30", "LHR35", "LHR5", "new", "new"]


def dated(spark, *numbers, day=14):
    return spark.createDataFrame([tuple({"flight_number": n, "scheduled_departure_utc": at(f"{day} 08:00")}.get(c) for c in FLIGHTS.names)
                                  for n in numbers], FLIGHTS)


def test_compaction_merges_small_loads(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    for n in range(12):
        tables.append_flights(dated(spark, f"F{n}", day=14 + n % 2), root)
    before = loaded(tables.read_tables(spark, root))
    merged = tables.compact(spark, root)
    assert len(merged) == 12 and len(ledger.live(spark, root)[0]) == 1
    files = list((tmp_path / "tables" / "flights").rglob("*.parquet"))
    assert len(files) == 2 and loaded(tables.read_tables(spark, root)) == before
    assert tables.compact(spark, root) == []


def test_compaction_drops_what_was_replaced(spark, synced, tmp_path):  # noqa: F811
    root = str(tmp_path / "tables")
    first = loaded(run_etl(spark, synced, root))
    run_etl(spark, synced, root, airports=["LHR"], repeat="replace")
    assert ledger.live(spark, root)[1] is not None
    tables.compact(spark, root)
    loads, gone = ledger.live(spark, root)
    assert len(loads) == 1 and gone is None and loaded(tables.read_tables(spark, root)) == first
    stored = spark.read.parquet(f"{root}/flights")
    assert stored.count() == len(first)
    # The merged load still knows its syncs.
    assert loaded(run_etl(spark, synced, root, repeat="skip")) == first
    assert loaded(run_etl(spark, synced, root, repeat="replace")) == first


def test_a_sync_replaced_during_compaction_stays_replaced(spark, synced, tmp_path, monkeypatch):  # noqa: F811
    root = str(tmp_path / "tables")
    first = loaded(run_etl(spark, synced, root))
    run_etl(spark, synced, root, airports=["CDG"])
    real = ledger.merge_loads

    def late(spark, root, merged, own, before):
        run_etl(spark, synced, root, airports=["CDG"], repeat="replace")
        return real(spark, root, merged, own, before)

    monkeypatch.setattr(ledger, "merge_loads", late)
    tables.compact(spark, root)
    assert loaded(tables.read_tables(spark, root)) == first


def test_stored_aircraft_are_not_shuffled(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    rows = lambda *regs: spark.createDataFrame([tuple(r if c == "aircraft_registration" else "x" for c in AIRCRAFT.names) for r in regs], AIRCRAFT)
    tables.insert_new_aircraft(rows("A", "B", "A"), root)
    key, before = "spark.sql.autoBroadcastJoinThreshold", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set(key, "-1")
    try:
        text = tables.new_aircraft(spark.table(tables._bucketed(spark, root)), rows("B", "C"))._jdf.queryExecution().executedPlan().toString()
        tables.insert_new_aircraft(rows("B", "C", "D"), root)
    finally:
        spark.conf.set(key, before)
    join = text[text.index("SortMergeJoin"):]
    assert len(re.findall(r"Exchange hashpartitioning", join)) == 1 and "Bucketed: true" in join
    stored = join[join.index("FileScan") - 200:]
    assert "Exchange" not in stored, text
    assert sorted(r.aircraft_registration for r in tables.read_tables(spark, root).aircraft.collect()) == ["A", "B", "C", "D"]


def test_the_catalog_follows_loads_without_listing_older_ones(spark, synced, tmp_path, monkeypatch):  # noqa: F811
    root, database = str(tmp_path / "tables"), "ledger_test"
    tables.create_tables(spark, root, database)
    tables.append_flights(dated(spark, "F1"), root, database=database)
    docs = feeds.read_airport_feed(spark, f"{synced}/airports")
    statements = []
    real = spark.sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (statements.append(text), real(text, *a, **k))[1])
    for repeat in ("append", "replace"):
        etl.load_feed(feeds.read_flight_feed(spark, f"{synced}/flights"), docs, root, database, repeat)
    monkeypatch.undo()
    assert not any("MSCK" in s for s in statements)
    added = [s for s in statements if "ADD IF NOT EXISTS" in s]
    assert len(added) == 4 and all(len(set(re.findall(r"load='(\w+)'", s))) == 1 for s in added)
    expected = loaded(tables.read_tables(spark, root))
    assert sorted(r.flight_number for r in spark.table(f"{database}.flights").collect()) == expected and expected[-1] == "LHR5"
    assert spark.table(f"{database}.airport_delays").count() == tables.read_tables(spark, root).airport_delays.count()
    assert sorted(r.name for r in spark.table(f"{database}.airport").collect()) == ["CDG Field", "Renamed"]
    assert spark.table(f"{database}.aircraft").count() == 6
    tables.compact(spark, root, database=database)
    assert sorted(r.flight_number for r in spark.table(f"{database}.flights").collect()) == expected


def test_a_loads_rows_are_sorted_by_date_alone(spark, tmp_path, monkeypatch):
    """The load's name is the folder and no column of the rows: a text equal in all rows would be compared at every step of the sort."""
    from pyspark.sql import DataFrameWriter

    from tests.rows import flights

    root, by = str(tmp_path), []
    tables.create_tables(spark, root)
    kept = DataFrameWriter.partitionBy
    monkeypatch.setattr(DataFrameWriter, "partitionBy", lambda self, *names: (by.append(names), kept(self, *names))[1])
    one = flights(spark, {"flight_number": "A1", "scheduled_departure_utc": at("14 08:00")}, {"flight_number": "A2"})
    for _ in range(2):
        tables.append_flights(one, root)
    tables.compact(spark, root)
    assert by.count(("flight_date",)) == 3
    assert sorted(r["flight_number"] for r in tables.read_tables(spark, root).flights.collect()) == ["A1", "A1", "A2", "A2"]


def test_empty_tables_start_no_python_worker(spark):
    from skyloom.session import no_rows

    empty = no_rows(spark, AIRPORT)
    assert empty.schema == AIRPORT and empty.count() == 0
    assert "ExistingRDD" not in empty._jdf.queryExecution().executedPlan().toString()
