"""Feeds and loads over small JSON documents."""

import datetime
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.functions.times import utc_timestamp
from skyloom.operators import airports as A
from skyloom.operators import delays as D
from skyloom.operators import movements as M
from skyloom.operators.airports import build_airport
from skyloom.plans.etl import run_etl
from skyloom.schemas import AIRCRAFT, FEED, FLIGHTS, TIME_COLUMNS
from skyloom.sources import feeds, tables
from tests.rows import at, tuples


def leg(iata=None, scheduled=None, revised=None, **airport):
    parts = {}
    if iata or airport:
        parts["airport"] = {**({"iata": iata} if iata else {}), **airport}
    if scheduled:
        parts["scheduledTime"] = {"utc": scheduled, "local": "ignored"}
    if revised:
        parts["revisedTime"] = {"utc": revised}
    return parts


def flight(number, status="Arrived", reg=None, model=None, **legs):
    aircraft = {k: v for k, v in {"reg": reg, "model": model}.items() if v is not None}
    return {"number": number, "status": status, "aircraft": aircraft,
            "airline": {"name": "Alpha", "iata": "AL", "icao": "ALP"}, **legs}


LHR = {
    "arrivals": [
        flight("A1", reg="G-1", model="Airbus A320", departure=leg("CDG", "2026-03-14 07:00Z", name="Paris"),
               arrival=leg(None, "2026-03-14 08:00Z", "2026-03-14 08:30Z")),
        # A codeshare of it, less late, with the same aircraft under another model.
        flight("B1", "Delayed", reg="G-1", model="Airbus A321", departure=leg("CDG", "2026-03-14T07:00:00Z", name="Paris"),
               arrival=leg(None, "2026-03-14 08:00Z", "2026-03-14T08:10:15Z")),
        flight("A2", "CanceledUncertain", model=" ", movement=leg("LHR", "2026-03-14 14:30+05:30")),
        flight("A3", None, reg="G-2", model="  Boeing   737", departure=leg("JFK"),
               arrival=leg("LHR", "2026-03-14 09:00Z", "2026-03-14 08:50Z"), movement=leg("XXX", "2026-03-15 09:00Z")),
        flight("A4", departure=leg("JFK"), arrival=leg("LHR", "junk", "2026-03-14 08:50Z")),
    ],
    "departures": [flight("D1", reg="G-2", model="Other", movement=leg(None, "2026-03-14 10:00Z"),
                          arrival=leg("XYZ", name="Nowhere"))],
}


def airport_doc(iata, **changes):
    doc = {
        "icao": f"E{iata}", "iata": iata, "fullName": f"{iata} Field", "municipalityName": "City",
        "country": {"code": "GB", "name": "Kingdom"}, "continent": {"name": "Europe"},
        "location": {"lat": 51.47, "lon": -0.45}, "timeZone": "Europe/London", **changes,
    }
    return {k: v for k, v in doc.items() if v is not ...}


@pytest.fixture
def feed_root(tmp_path):
    documents = {"LHR": LHR, "QQQ": {"arrivals": [flight("Q1", arrival=leg(None, "2026-03-14 08:00Z"))]},
                 "NIL": {"arrivals": [], "departures": []}, "BAD": {"departures": [flight("X1")]}}
    airports = {"LHR": airport_doc("LHR"), "QQQ": airport_doc("QQQ", icao="EQQQ", timeZone=None),
                "NIL": airport_doc("NIL"), "BAD": airport_doc("BAD", timeZone=..., location={"lat": 1})}
    for folder, prefix, items in [("flights", "flight_data_", documents), ("airports", "airport_", airports)]:
        (tmp_path / folder).mkdir()
        for iata, document in items.items():
            text = json.dumps(document, ensure_ascii=False, indent=4)
            (tmp_path / folder / f"{prefix}{iata}.json").write_text(text, encoding="utf-8")
    return str(tmp_path)


def cleaned(spark, root):
    feed = feeds.read_flight_feed(spark, f"{root}/flights", multi_line=True)
    return M.clean_movements(feed, A.airport_defaults(spark))


def test_raw_documents_are_flattened_in_order(spark, feed_root):
    feed = feeds.read_flight_feed(spark, f"{feed_root}/flights", multi_line=True)
    assert sorted(r.airport_iata for r in feed.collect()) == ["BAD", "LHR", "NIL", "QQQ"]
    rows = M.explode_feed(feed.filter("airport_iata = 'LHR'")).orderBy("movement_rank", "pos").collect()
    assert [(r.number, r.movement_type) for r in rows] == [
        ("A1", "Arrival"), ("B1", "Arrival"), ("A2", "Arrival"), ("A3", "Arrival"), ("A4", "Arrival"), ("D1", "Departure")]
    assert M.explode_feed(feed).filter("airport_iata = 'NIL'").count() == 0


def test_movement_defaults_and_times(spark, feed_root):
    rows = {r.flight_number: r for r in cleaned(spark, feed_root).collect()}
    a1, a2, a3, d1 = (rows[n] for n in ("A1", "A2", "A3", "D1"))
    # The queried airport is filled in on its own side only.
    assert (a1.destination_iata, a1.destination_icao, a1.destination_country_code) == ("LHR", "EGLL", "gb")
    assert (a1.origin_iata, a1.origin_icao, a1.origin_name) == ("CDG", None, "Paris")
    assert (d1.origin_iata, d1.origin_name, d1.destination_icao) == ("LHR", "London Heathrow", None)
    # The short form stands for the list's side; a full leg wins over it.
    assert (a2.origin_iata, a2.scheduled_arrival_utc) == (None, at("14 09:00"))
    assert (a3.destination_iata, a3.scheduled_arrival_utc) == ("LHR", at("14 09:00"))
    assert d1.scheduled_departure_utc == at("14 10:00")
    assert rows["A4"].scheduled_arrival_utc is None and rows["A4"].actual_arrival_utc == at("14 08:50")
    # An unknown airport is left alone.
    assert (rows["Q1"].destination_iata, rows["Q1"].destination_name) == (None, None)
    assert [rows[n].aircraft_manufacturer for n in ("A1", "A2", "A3", "A4")] == ["Airbus", None, "Boeing", None]


def test_first_aircraft_row_wins(spark, feed_root):
    rows = M.build_aircraft(cleaned(spark, feed_root)).orderBy("aircraft_registration").collect()
    assert [(r.aircraft_registration, r.flight_number, r.aircraft_model) for r in rows] == [
        ("G-1", "A1", "Airbus A320"), ("G-2", "A3", "  Boeing   737")]


def test_delays(spark, feed_root):
    delays = D.compute_delays(cleaned(spark, feed_root))
    rows = {r.flight_number: r for r in delays.collect()}
    assert set(rows) == {"A1", "B1", "A2", "A3", "A4", "Q1"}
    assert [(rows[n].delay_min, rows[n].is_delayed, rows[n].is_canceled) for n in ("A1", "B1", "A2", "A3", "A4")] == [
        (30.0, True, False), (10.25, True, False), (0.0, False, True), (-10.0, False, False), (0.0, False, False)]
    # B1 is a codeshare of A1. A2 and A3 both lack an origin name, which makes them one route, and the
    # early A3 has the smaller delay.
    assert sorted(r.flight_number for r in D.dedupe_codeshares(delays).filter("airport_iata = 'LHR'").collect()) == [
        "A1", "A2", "A4"]
    summary = {r.airport_iata: tuple(r)[1:] for r in D.delay_summary(D.dedupe_codeshares(delays)).collect()}
    day = datetime.date(2026, 3, 14)
    # A4 has no scheduled time and so no day.
    assert summary == {"LHR": (day, 2, 1, 30, 30, 1), "QQQ": (day, 1, 0, 0, 0, 0)}


def test_delay_summary_rounds_half_even_and_ignores_early_flights(spark):
    def row(minute, seconds, name):
        return ("LHR", 1, at("14 08:00").replace(minute=minute), datetime.date(2026, 3, 14), seconds * 1_000_000,
                seconds > 0, False, name)
    schema = ("airport_iata string, ingest_seq long, sched_time timestamp_ntz, delay_date date, delay_us long, "
              "is_delayed boolean, is_canceled boolean, origin_name string")
    df = spark.createDataFrame([row(0, 60, "a"), row(1, 240, "b"), row(2, -6000, "c"), row(2, 0, "d")], schema)
    # Mean and median of 1 and 4 minutes are 2.5.
    assert tuples(D.delay_summary(df))[0][2:] == (3, 2, 2, 2, 0)


def test_times_do_not_depend_on_the_session_zone(spark):
    texts = {
        "2026-03-08 02:30Z": at("08 02:30"),
        "2026-03-08T02:30:15Z": at("08 02:30").replace(second=15),
        "2026-03-08 02:30:15.25+00:00": at("08 02:30").replace(second=15, microsecond=250000),
        "2026-03-08 08:00+05:30": at("08 02:30"),
        "2026-03-07 21:30-05:00": at("08 02:30"),
        "2026-03-08 02:30": at("08 02:30"),
        "2026-03-08 02:30:00": at("08 02:30"),
        "2026-03-08 25:30Z": None, "junk": None, "": None, "12:30:00": None, "2026-13-08 02:30Z": None, None: None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("text", F.col("t"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ["America/New_York", "UTC", "Asia/Kolkata"]:
            spark.conf.set("spark.sql.session.timeZone", other)
            parsed = M.parse_utc(df, ["t", "absent"])
            assert {r.text: r.t for r in parsed.collect()} == texts
            safe = M.sql_safe(parsed.filter("text LIKE '%.25%'"), as_text=True)
            assert safe.first().t == "2026-03-08 02:30:15"
            span = parsed.filter("text = '2026-03-08 02:30Z'").select(
                D.micros_between(F.lit("2026-03-08 01:00:00").cast("timestamp_ntz"), F.col("t")).alias("us"),
                D.micros_between(F.col("t"), F.lit("2026-03-08 02:29:59.5").cast("timestamp_ntz")).alias("back"))
            assert tuples(span) == [(90 * 60 * 1_000_000, -500_000)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_ensure_columns(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert M.ensure_columns(df, ["a", "b"]).schema.simpleString() == "struct<a:int,b:string>"
    assert M.ensure_columns(df, {"c": "timestamp_ntz"}).first().c is None
    assert M.ensure_columns(df, []).columns == ["a"]


def test_airport_documents(spark, feed_root):
    docs = A.build_airport(feeds.read_airport_feed(spark, f"{feed_root}/airports", multi_line=True))
    missing = {r.iata_code: r.missing for r in docs.collect()}
    # A null field is present, an absent one is not.
    assert missing == {"LHR": [], "NIL": [], "QQQ": [], "BAD": ["longitude", "timezone"]}
    assert {r.iata_code for r in A.accepted_airports(docs).collect()} == {"LHR", "NIL", "QQQ"}
    assert [r.iata_code for r in A.rejected_airports(docs).collect()] == ["BAD"]
    row = docs.filter("iata_code = 'LHR'").first()
    assert (row.icao_code, row.country, float(row.latitude), row.timezone) == ("ELHR", "Kingdom", 51.47, "Europe/London")

    defaults = {r.iata: tuple(r)[1:] for r in A.extend_airport_defaults(A.airport_defaults(spark), docs).collect()}
    assert len(defaults) == 16 and defaults["LHR"] == ("EGLL", "London Heathrow", "gb")
    assert defaults["BAD"] == ("EBAD", "BAD Field", "gb")
    bare = docs.limit(1).selectExpr("ingest_seq", "doc_id", "'NEW' AS iata_code", "string(NULL) AS icao_code",
                                    "string(NULL) AS name", "string(NULL) AS country_code")
    assert tuples(A.extend_airport_defaults(A.airport_defaults(spark).limit(0), bare)) == [("NEW", "", "NEW", "")]


def test_archive_replaces_only_the_synced_airport(spark, feed_root, tmp_path):
    path = str(tmp_path / "archive")
    feed = feeds.read_flight_feed(spark, f"{feed_root}/flights", multi_line=True)
    feeds.archive_feed(feed, path)
    again = feeds.read_flight_feed(spark, path)
    assert sorted(map(str, tuples(again))) == sorted(map(str, tuples(feed)))
    feeds.archive_feed(feed.filter("airport_iata = 'LHR'").withColumn("arrivals", F.slice("arrivals", 1, 1)), path)
    sizes = {r.airport_iata: len(r.arrivals or []) for r in feeds.read_flight_feed(spark, path).collect()}
    assert sizes == {"LHR": 1, "QQQ": 1, "NIL": 0, "BAD": 0}


def test_run_etl(spark, feed_root, tmp_path):
    root = str(tmp_path / "tables")
    loaded = run_etl(spark, feed_root, root, multi_line=True)
    # BAD lacks columns and NIL has no flights: both are skipped, the others load.
    assert sorted(r.iata_code for r in loaded.airport.collect()) == ["LHR", "QQQ"]
    assert sorted(r.flight_number for r in loaded.flights.collect()) == ["A1", "A2", "A3", "A4", "B1", "D1", "Q1"]
    assert loaded.flights.schema.simpleString() == FLIGHTS.simpleString()
    assert loaded.aircraft.count() == 2 and loaded.airport_delays.count() == 2
    # An extended default fills the airport that the built-in ones do not know.
    assert loaded.flights.filter("flight_number = 'Q1'").first().destination_name == "QQQ Field"
    tables.read_tables(spark, root, views=True)
    assert spark.sql("SELECT count(*) AS n FROM flights WHERE flight_number = 'A1'").first().n == 1
    assert sorted((r.iata_code, r.reason.split(":")[0]) for r in loaded.skipped.collect()) == [
        ("BAD", "missing"), ("NIL", "no flight data")]

    # A repeated sync doubles flights and delays and leaves airports and aircraft as they are.
    again = run_etl(spark, feed_root, root, multi_line=True)
    assert (again.airport.count(), again.flights.count(), again.aircraft.count(), again.airport_delays.count()) == (
        2, 14, 2, 4)


def test_a_load_can_choose_airports(spark, feed_root, tmp_path):
    loaded = run_etl(spark, feed_root, str(tmp_path / "tables"), multi_line=True, airports=["QQQ"])
    assert [r.flight_number for r in loaded.flights.collect()] == ["Q1"]


def test_dedupe_keys_and_cut_text(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    names = FLIGHTS.names
    rows = [
        {"flight_number": "X" * 30, "status": "a"}, {"flight_number": None, "status": "a"},
        {"flight_number": None, "status": "b"}, {"flight_number": "1", "scheduled_departure_utc": at("14 08:00")},
    ]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FLIGHTS)
    for _ in range(2):
        tables.append_flights(df, root, dedupe_keys=["flight_number", "scheduled_departure_utc"])
    stored = tables.read_tables(spark, root).flights
    assert sorted(str(r.flight_number) for r in stored.collect()) == ["1", "None", "X" * 30]
    assert all(f.dataType.simpleString() == "timestamp_ntz" for f in stored.schema if f.name in TIME_COLUMNS)
    tables.append_flights(df, root, cut_text=True)
    assert tables.read_tables(spark, root).flights.filter(F.length("flight_number") == 20).count() == 1


@pytest.mark.parametrize("cut, kept", [(False, ["R" * 20 + "1", "R" * 20 + "2"]), (True, ["R" * 20])])
def test_registrations_stay_unique(spark, tmp_path, cut, kept):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    rows = [{"aircraft_registration": "R" * 20 + n} for n in "1212"]
    df = spark.createDataFrame([tuple(r.get(n) for n in AIRCRAFT.names) for r in rows], AIRCRAFT)
    for _ in range(2):
        tables.insert_new_aircraft(df, root, cut_text=cut)
    stored = tables.read_tables(spark, root).aircraft
    assert sorted(r.aircraft_registration for r in stored.collect()) == kept


def test_catalog_tables(spark, tmp_path):
    root = str(tmp_path / "tables")
    tables.create_tables(spark, root)
    df = spark.createDataFrame([tuple(None for _ in FLIGHTS.names)] * 2, FLIGHTS)
    tables.append_flights(df, root)
    for _ in range(2):
        tables.create_tables(spark, root, database="flightops_test")
    assert spark.table("flightops_test.flights").count() == 2
    assert spark.table("flightops_test.aircraft").count() == 0


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_text_that_is_no_time_is_null(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        bad = ["08:00", "T8:00", "2026-03-14T08", "2026-03-14", "2026-03-14 08:00" + " " * 97 + "junk", "2026-03-14 08:00z",
               "2026-03-14 08:00Z" + "x" * 200, "2026-13-14 08:00", "", None]
        good = ["2026-03-14 08:00", "2026-03-14T08:00:00Z", "2026-03-14 13:30+05:30", "2026-03-14 08:00" + " " * 97 + "Z"]
        rows = spark.createDataFrame([(t,) for t in bad + good], "text string").select(utc_timestamp(F.col("text")).alias("t"))
        assert [r.t for r in rows.collect()] == [None] * len(bad) + [at("14 08:00")] * len(good)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_a_code_of_digits_stays_text(spark, tmp_path):
    raw = spark.createDataFrame([("007", 1, "d", None, None)], T.StructType([
        T.StructField("airport_iata", T.StringType()), T.StructField("ingest_seq", T.LongType()),
        T.StructField("doc_id", T.StringType()), *FEED.fields]))
    feeds.archive_feed(raw, str(tmp_path / "feed"))
    assert feeds.read_flight_feed(spark, str(tmp_path / "feed")).first().airport_iata == "007"


def test_null_country_counts_as_present(spark):
    json = '{"ingest_seq":1,"doc_id":"a","icao":"I","iata":"A","fullName":"N","municipalityName":"M","country":null,' \
           '"continent":null,"location":%s,"timeZone":"UTC"}'
    docs = spark.createDataFrame([(json % '{"lat":1,"lon":2}',), (json % "null",)], "j string").selectExpr(
        "1L AS ingest_seq", "'a' AS doc_id", "parse_json(j) AS doc")
    assert sorted(",".join(r.missing) for r in build_airport(docs).collect()) == ["", "latitude,longitude"]


def test_archives_are_compressed(spark, tmp_path):
    path = str(tmp_path / "archive")
    listed = [({"number": f"A{i}", "status": "Arrived"},) for i in range(3)]
    feed = spark.createDataFrame([("LHR", i, f"d{i}", list(x), []) for i, x in enumerate(listed)], feeds._ARCHIVED.simpleString().replace(
        "struct<", "airport_iata: string, ", 1)[:-1].replace(":", ": "))
    feeds.archive_feed(feed, path, syncs_per_folder=32)
    files = [f for f in (tmp_path / "archive").rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert tuples(feeds.read_flight_feed(spark, path).orderBy("doc_id")) == tuples(feed.orderBy("doc_id"))
