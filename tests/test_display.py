import pytest

from skyloom.plans import display
from tests.rows import tuples


def test_percent_share_rounds_half_even(spark):
    # 1/16 = 6.25 and 3/16 = 18.75 lie half-way.
    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 12)], "k string, n int")
    assert [r.Percentage for r in display.with_percent_share(df, "n").orderBy("k").collect()] == ["6.2%", "18.8%", "75.0%"]
    assert tuples(display.with_percent_share(df.limit(0), "n")) == []


def test_status_percentages_are_per_airline_name(spark):
    df = spark.createDataFrame(
        [("A", "x", 1, 1, 0), ("A", "y", 2, 0, 0), ("B", "x", 0, 0, 0)],
        "airline_name string, airline_code_iata string, on_time_flights long, delayed_flights long, cancelled_flights long",
    )
    assert sorted(tuples(display.status_percentages(df))) == [("A", 75.0, 25.0, 0.0), ("B", None, None, None)]


def test_counts_labels_and_names(spark):
    df = spark.createDataFrame([("International",), ("Domestic",), ("International",)], "flight_type string")
    assert tuples(display.classification_counts(df)) == [("International", 2), ("Domestic", 1)]
    usage = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), (None, 1)], "aircraft_model string, total_flights long")
    assert tuples(display.top_n_models(usage, 2)) == [("c", 5), ("a", 2)]
    assert display.display_names(usage, "top_n_models").columns == ["Aircraft Model", "Number of Flights"]
    assert display.display_names(usage, ["x", "y"]).columns == ["x", "y"]
    pairs = spark.createDataFrame([("A", "B"), ("A", None)], "origin_name string, destination_name string")
    assert [r.Route for r in display.route_label(pairs).collect()] == ["A ➔ B", None]


def test_fill_display(spark):
    df = spark.sql("SELECT 'x' AS `a b`, timestamp_ntz'2026-03-14 08:00:00' AS t UNION ALL SELECT NULL, NULL")
    assert tuples(display.fill_display(df, "Not Available")) == [
        ("x", "2026-03-14 08:00:00"), ("Not Available", "Not Available")]
    assert tuples(display.fill_display(df))[1] == ("", "")


def test_polyline_vertices(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "origin_lat double, origin_lon double, dest_lat double, dest_lon double")
    assert [tuple(r)[4:] for r in display.polyline_vertices(df).collect()] == [(0, 1.0, 2.0), (1, 3.0, 4.0), (2, None, None)]


def test_airport_labels(spark):
    df = spark.createDataFrame(
        [("BBB", "Beta"), ("AAA", "Alpha"), (None, "Gamma"), (None, "Gamma"), ("Global View", "All Airports")],
        "iata_code string, name string",
    )
    assert tuples(display.airport_labels(df)) == [
        ("All Airports (Global View)", "Global View"), ("Alpha (AAA)", "AAA"), ("Beta (BBB)", "BBB"),
        ("Gamma (None)", None),
    ]


@pytest.mark.parametrize("value, text", [(12.25, "12.2%"), (12.35, "12.4%"), (100.0, "100.0%"), (0.0, "0.0%"), (None, None)])
def test_percent_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "percent_delayed double")
    assert display.percent_text(df).first().text == text


def test_point_labels(spark):
    points = spark.createDataFrame([("Beta", 1.0, 2.0, 3)], "name string, latitude double, longitude double, count long")
    home = spark.createDataFrame([(5.0, 6.0)], "latitude double, longitude double")
    assert sorted(tuples(display.point_labels(points, points, home, "AAA"))) == [
        ("AAA (Selected)", 5.0, 6.0), ("Beta (Destination)", 1.0, 2.0), ("Beta (Origin)", 1.0, 2.0)]
