"""Rules of the reports, each with rows for which the wrong reading gives another answer."""

import pytest

from skyloom.plans import airlines, fleet, network, operations, routes
from tests.rows import aircraft, airports, arrival, at, departure, flights, tuples


@pytest.fixture(scope="module")
def planes(spark):
    return aircraft(
        spark,
        dict(aircraft_registration="R1", flight_number="A1", aircraft_model="Airbus A320", airline_name="Alpha",
             airline_code_iata="AL", aircraft_manufacturer="Airbus"),
        dict(aircraft_registration="R2", flight_number="A2", aircraft_model="Boeing 737", airline_name="Alpha",
             airline_code_iata="AL", aircraft_manufacturer="Boeing"),
        dict(aircraft_registration="R3", flight_number="A3", aircraft_model="Airbus A321", airline_name="Beta",
             airline_code_iata="AL", aircraft_manufacturer="Airbus"),
        dict(aircraft_registration="R4", flight_number="A1", aircraft_model=None, airline_name=None,
             airline_code_iata="GA", aircraft_manufacturer=None),
    )


def test_every_stored_listing_counts_for_manufacturers(spark, planes):
    rows = flights(
        spark,
        departure("AAA", "BBB", aircraft_registration="R1"),
        departure("AAA", "BBB", aircraft_registration="R1"),
        departure("CCC", "AAA", aircraft_registration="R3"),
        departure("BBB", "CCC", aircraft_registration="R2"),
        departure("BBB", "CCC", aircraft_registration="R4"),
        departure("BBB", "CCC", aircraft_registration="unknown"),
        departure("BBB", "CCC", aircraft_registration=None),
    )
    assert tuples(fleet.manufacturer_share(rows, planes)) == [("Airbus", 3), (None, 1), ("Boeing", 1)]
    assert tuples(fleet.manufacturer_share(rows, planes, "AAA")) == [("Airbus", 3)]
    assert tuples(fleet.models_by_manufacturer(rows, planes, "Airbus")) == [("Airbus A320", 2), ("Airbus A321", 1)]
    assert tuples(fleet.models_by_manufacturer(rows, planes, "Airbus", "CCC")) == [("Airbus A321", 1)]


def test_model_usage_counts_physical_flights(spark, planes):
    same = dict(scheduled_departure_utc=at("14 08:00"))
    rows = flights(
        spark,
        departure("AAA", "BBB", aircraft_registration="R2", **same),
        departure("AAA", "BBB", aircraft_registration="R1", **same),
        departure("AAA", "BBB", aircraft_registration=None, **same),
        departure("AAA", None, aircraft_registration="R3", **same),
        departure("AAA", None, aircraft_registration="R2", **same),
        departure("AAA", "CCC", aircraft_registration=None, **same),
        departure("DDD", "CCC", aircraft_registration="R1"),
        departure("DDD", "CCC", aircraft_registration="R1"),
    )
    # One flight per group: R1; for the unknown destination R2; none for CCC; one for the unknown times.
    assert tuples(fleet.model_usage(rows, planes)) == [("Airbus A320", 2), ("Boeing 737", 1)]
    assert tuples(fleet.model_usage(rows, planes, "BBB")) == [("Airbus A320", 1)]
    assert tuples(fleet.busy_aircraft(rows, planes, 1)) == [("R1", "Airbus A320", 2)]
    assert tuples(fleet.busy_aircraft(rows, planes, 2)) == []


def test_frequent_routes_skip_schedules_with_a_gap(spark):
    rows = [
        departure("AAA", "BBB", scheduled_departure_utc=at(f"14 0{h}:00"), scheduled_arrival_utc=at("14 10:00"))
        for h in (1, 1, 2, 3)
    ]
    rows += [departure("AAA", "BBB", scheduled_departure_utc=at(f"15 0{h}:00")) for h in range(5)]
    rows += [departure(None, "BBB", scheduled_departure_utc=at("14 01:00"), scheduled_arrival_utc=at("14 02:00"))]
    df = flights(spark, *rows)
    assert tuples(operations.frequent_routes(df, min_flights=2)) == [("AAA City", "BBB City", 3)]
    assert tuples(operations.frequent_routes(df, min_flights=3)) == []
    assert tuples(operations.frequent_routes(df, "BBB", min_flights=0)) == []
    # A route with a missing name counts no schedule at all.
    assert (None, "BBB City", 0) in tuples(operations.frequent_routes(df, min_flights=-1))


def test_top_origins_count_flight_numbers(spark):
    rows = [arrival("AAA", "ZZZ", flight_number=n, scheduled_arrival_utc=at("14 08:00")) for n in ("1", "1", "2", None)]
    rows += [arrival("BBB", "ZZZ", flight_number="1", scheduled_arrival_utc=at(f"14 0{h}:00")) for h in range(3)]
    rows += [departure("CCC", "ZZZ", flight_number=str(n), scheduled_arrival_utc=at("14 08:00")) for n in range(9)]
    rows += [arrival("DDD", "YYY", flight_number="1", scheduled_arrival_utc=at("14 08:00"))]
    df = flights(spark, *rows)
    result = operations.top_origins(df, "ZZZ")
    assert result.columns == ["origin_airport", "IATA", "total_flights"]
    assert tuples(result) == [("BBB City", "BBB", 3), ("AAA City", "AAA", 2)]
    assert len(tuples(operations.top_origins(df, k=1))) == 1


def test_classification_keeps_the_lowest_number(spark):
    time = dict(scheduled_departure_utc=at("14 08:00"))
    df = flights(
        spark,
        departure("AAA", "BBB", flight_number="X2", origin_country_code="gb", destination_country_code="gb", **time),
        departure("AAA", "BBB", flight_number="X1", origin_country_code="gb", destination_country_code="gb", **time),
        departure("AAA", "CCC", flight_number="X3", origin_country_code="gb", **time),
        departure("AAA", "DDD", flight_number="X4", **time),
        arrival("AAA", "EEE", flight_number="X5", **time),
    )
    assert sorted(tuples(operations.flight_classification(df))) == [
        ("X1", "AAA City", "BBB City", "Domestic"),
        ("X3", "AAA City", "CCC City", "International"),
        ("X4", "AAA City", "DDD City", "International"),
    ]
    kinds = [row.flight_type for row in operations.flight_classification(df, "AAA").collect()]
    assert kinds == ["International", "International", "Domestic"]
    assert tuples(operations.flight_classification(df, "BBB")) == []


def test_recent_arrivals(spark):
    df = flights(
        spark,
        arrival("AAA", "ZZZ", flight_number="2", actual_arrival_utc=at("14 09:00")),
        arrival("AAA", "ZZZ", flight_number="1", actual_arrival_utc=at("14 09:00")),
        arrival("BBB", "ZZZ", flight_number="3", actual_arrival_utc=at("14 10:00")),
        arrival("BBB", "ZZZ", flight_number="4", actual_arrival_utc=at("14 08:00")),
        arrival("BBB", "ZZZ", flight_number="6"),
        arrival("BBB", "ZZZ", flight_number="5"),
        departure("CCC", "ZZZ", flight_number="7", actual_arrival_utc=at("14 11:00")),
    )
    result = operations.recent_arrivals(df)
    assert result.columns == ["flight_number", "departure_airport", "origin_airport", "arrival_time"]
    assert [r.flight_number for r in result.collect()] == ["3", "1", "4", "5"]
    assert result.first()[1:3] == ("BBB City", "ZZZ City")
    assert [r.flight_number for r in operations.recent_arrivals(df, "ZZZ", 2).collect()] == ["3", "1"]
    assert tuples(operations.recent_arrivals(df, "AAA")) == []


def pairs(df):
    return sorted(((r.origin_airport_code, r.destination_airport_code) for r in df.collect()), key=str)


def test_outbound_only_for_all_airports(spark):
    df = flights(
        spark,
        departure("AAA", "BBB"), departure("AAA", "BBB"), arrival("BBB", "AAA"),
        departure("AAA", "CCC"), departure("AAA", None), departure(None, "AAA"),
        departure("DDD", "DDD"), departure("CCC", "BBB"),
    )
    result = routes.outbound_only_routes(df)
    assert result.columns == ["origin_name", "origin_airport_code", "destination_name", "destination_airport_code"]
    assert pairs(result) == [("AAA", "CCC"), ("AAA", None), ("CCC", "BBB")]
    assert pairs(routes.outbound_only_routes(df, "ALL")) == pairs(result)


def test_outbound_only_for_one_airport_follows_not_in(spark):
    returned = [departure("AAA", "BBB"), departure("AAA", "CCC"), departure("AAA", None), departure("BBB", "AAA")]
    assert pairs(routes.outbound_only_routes(flights(spark, *returned), "AAA")) == [("AAA", "CCC")]
    # Nothing known flies in: an unknown destination stays.
    lonely = [departure("AAA", "BBB"), departure("AAA", None), departure(None, "AAA")]
    assert pairs(routes.outbound_only_routes(flights(spark, *lonely), "AAA")) == [("AAA", "BBB"), ("AAA", None)]
    assert pairs(routes.outbound_only_routes(flights(spark, *lonely), "BBB")) == []


def test_outbound_only_modes_agree_without_nulls(spark):
    df = flights(spark, *[
        departure(a, b) for a, b in ["AB", "BA", "AC", "CD", "DC", "DA", "BD", "BB", "EA"]
    ])
    every = pairs(routes.outbound_only_routes(df))
    assert every == sorted(p for code in "ABCDE" for p in pairs(routes.outbound_only_routes(df, code)))


def test_airline_performance(spark, planes):
    sched = at("14 08:00")
    def one(origin, **more):
        return arrival(origin, "ZZZ", scheduled_arrival_utc=sched, airline_code_iata="AL", **more)
    df = flights(
        spark,
        one("AAA", status="Arrived", actual_arrival_utc=at("14 07:50")),
        one("BBB", status="Arrived", actual_arrival_utc=at("14 08:10")),
        one("CCC", status="Delayed", actual_arrival_utc=at("14 08:00")),
        one("DDD", status="Arrived"),
        one("EEE", status="Canceled", actual_arrival_utc=at("14 07:00")),
        one("FFF", status="CanceledUncertain"),
        # Two listings of one flight: the later arrival counts.
        one("GGG", status="Arrived", actual_arrival_utc=at("14 07:00")),
        one("GGG", status="Arrived", actual_arrival_utc=at("14 09:00")),
        one("GGG", status="Canceled"),
        arrival("HHH", "ZZZ", scheduled_arrival_utc=sched, airline_code_iata="??", status="Arrived"),
    )
    expected = [("Alpha", "AL", 2, 3, 1), ("Beta", "AL", 2, 3, 1)]
    assert tuples(airlines.airline_performance(df, planes)) == expected
    assert tuples(airlines.airline_performance(df, planes, "ZZZ")) == expected
    assert tuples(airlines.airline_performance(df, planes, "AAA")) == []


@pytest.fixture(scope="module")
def places(spark):
    return airports(
        spark,
        dict(iata_code="AAA", icao_code="KAAA", name="Alpha Field", city="A", latitude=1, longitude=-1),
        dict(iata_code="BBB", icao_code="KBBB", name="Beta Field", city="B", latitude=2, longitude=-2),
        dict(iata_code="CCC", icao_code="KCCC", name="Gamma Field", city="C", latitude=3, longitude=-3),
    )


def test_cancelled_flights(spark, places):
    time = dict(scheduled_departure_utc=at("14 08:00"))
    df = flights(
        spark,
        departure("AAA", "BBB", status="Canceled", flight_number="2", aircraft_registration="R2", **time),
        departure("AAA", "BBB", status="Canceled", flight_number="1", **time),
        departure("AAA", "BBB", status="CanceledUncertain", flight_number="0", **time),
        departure("AAA", "XXX", status="Canceled", flight_number="3", **time),
        arrival("BBB", "AAA", status="Canceled", flight_number="4", scheduled_departure_utc=at("15 08:00")),
        arrival("BBB", "AAA", status="Canceled", flight_number="5"),
    )
    assert tuples(operations.cancelled_flights(df, places)) == [
        ("4", None, "Beta Field", "Alpha Field", at("15 08:00")),
        ("1", None, "Alpha Field", "Beta Field", at("14 08:00")),
        ("5", None, "Beta Field", "Alpha Field", None),
    ]
    assert [r.flight_number for r in operations.cancelled_flights(df, places, "AAA").collect()] == ["1"]


def test_route_diversity_joins_on_flight_number(spark):
    models = aircraft(spark, *[
        dict(aircraft_registration=f"R{i}", flight_number=n, aircraft_model=m)
        for i, (n, m) in enumerate([("1", "X"), ("1", "Y"), ("1", "X"), ("2", "Z"), ("3", None), (None, "W")])
    ])
    df = flights(
        spark,
        departure("AAA", "BBB", flight_number="1", scheduled_departure_utc=at("14 08:00")),
        departure("AAA", "BBB", flight_number="2", scheduled_departure_utc=at("14 09:00")),
        # A codeshare of the flight above with a higher number does not count.
        departure("AAA", "CCC", flight_number="2", scheduled_departure_utc=at("14 08:00")),
        departure("AAA", "CCC", flight_number="1", scheduled_departure_utc=at("14 08:00")),
        departure("BBB", "CCC", flight_number="3", scheduled_departure_utc=at("14 08:00")),
        departure("BBB", "CCC", flight_number=None, scheduled_departure_utc=at("14 09:00")),
    )
    assert tuples(routes.route_diversity(df, models)) == [("AAA City", "BBB City", 3)]
    assert tuples(routes.route_diversity(df, models, min_models=1)) == [
        ("AAA City", "BBB City", 3), ("AAA City", "CCC City", 2)]
    assert ("BBB City", "CCC City", 0) in tuples(routes.route_diversity(df, models, min_models=-1))


def test_delay_sources_count_distinct_pairs(spark):
    def one(origin, number, minute, late, **more):
        return arrival(origin, "ZZZ", flight_number=number, scheduled_arrival_utc=at("14 08:00").replace(minute=minute),
                       actual_arrival_utc=at("14 09:00" if late else "14 07:00"), status="Arrived", **more)
    rows = [one("AAA", "1", m, m < 2) for m in range(4)] + [one("AAA", "1", 0, True), one("AAA", "1", 3, True)]
    rows += [one("AAA", None, 9, True), one("BBB", "1", 0, True), one("BBB", "1", 1, True), one("BBB", "2", 1, True)]
    rows += [one("CCC", "1", 0, True), one("CCC", "1", 1, True)]
    rows += [{**one("DDD", str(n), 0, True), "status": "Delayed"} for n in range(5)]
    df = flights(spark, *rows)
    assert tuples(operations.delay_sources(df, "ZZZ")) == [("BBB City", "BBB", 100.0, 3), ("AAA City", "AAA", 75.0, 4)]
    assert tuples(operations.delay_sources(df, k=1)) == [("BBB City", "BBB", 100.0, 3)]
    only_unknown = flights(spark, one("EEE", None, 0, True))
    assert tuples(operations.delay_sources(only_unknown, min_flights=-1)) == [("EEE City", "EEE", None, 0)]


def test_top_model_by_airline(spark, planes):
    df = flights(spark, *[departure("A", "B", aircraft_registration=r) for r in ("R2", "R1", "R3", "R3", "R4")])
    assert tuples(fleet.top_model_by_airline(df, planes)) == [("Alpha", "Airbus A320", 1), ("Beta", "Airbus A321", 2)]


def test_network(spark, places):
    df = flights(
        spark,
        departure("AAA", "BBB", flight_number="1"), departure("AAA", "BBB", flight_number=None),
        arrival("AAA", "BBB", flight_number="1"), departure("BBB", "XXX", flight_number="2"), departure(None, "AAA"),
    )
    number = lambda rows: [tuple(float(v) if hasattr(v, "as_tuple") else v for v in r) for r in rows]
    assert number(tuples(network.route_segments(df, places))) == [(1, -1, 2, -2)]
    assert sorted(r.name for r in network.active_airports(df, places).collect()) == ["Alpha Field", "Beta Field"]
    assert number(tuples(network.airport_position(places, "CCC"))) == [(3, -3)]
    assert number(tuples(network.airport_position(places, "nowhere"))) == [(0, 0)]
    assert number(tuples(network.outbound_destinations(df, places, "AAA"))) == [("Beta Field", 2, -2, 2)]
    assert number(tuples(network.inbound_origins(df, places, "BBB"))) == [("Alpha Field", 1, -1, 2)]
    segments = network.airport_segments(
        network.outbound_destinations(df, places, "AAA"), network.airport_position(places, "AAA"))
    assert number(tuples(segments)) == [("Beta Field", 1, -1, 2, -2)]
    assert [r.iata_code for r in network.airport_list(places).collect()] == ["AAA", "BBB", "CCC"]
    assert network.has_data(places) and not network.has_data(places.limit(0))
    assert tuples(network.data_present(places.limit(0))) == [(False,)]


def test_no_airport_means_all(spark, planes, places):
    df = flights(spark, departure("AAA", "BBB", flight_number="A1", aircraft_registration="R1", status="Canceled"),
                 arrival("BBB", "AAA", flight_number="A1", aircraft_registration="R1", status="Arrived"))
    for report in [
        lambda code: fleet.manufacturer_share(df, planes, code),
        lambda code: fleet.models_by_manufacturer(df, planes, "Airbus", code),
        lambda code: fleet.model_usage(df, planes, code),
        lambda code: operations.frequent_routes(df, code, -1),
        lambda code: operations.top_origins(df, code),
        lambda code: operations.flight_classification(df, code),
        lambda code: operations.recent_arrivals(df, code),
        lambda code: routes.outbound_only_routes(df, code),
        lambda code: airlines.airline_performance(df, planes, code),
        lambda code: operations.cancelled_flights(df, places, code),
        lambda code: routes.route_diversity(df, planes, code, -1),
        lambda code: operations.delay_sources(df, code, -1),
    ]:
        assert tuples(report(None)) == tuples(report("ALL"))
        assert len(tuples(report("nowhere'--"))) == 0
