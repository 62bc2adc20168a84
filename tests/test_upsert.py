"""The airport upsert against a row-by-row model."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from skyloom.operators.airports import upsert_airports
from skyloom.schemas import AIRPORT

SCHEMA = "ingest_seq long, doc_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in AIRPORT)


def modelled(existing, incoming):
    """Load one row at a time; None when a row hits two stored rows, which is undefined."""
    stored = [list(row) for row in existing]
    for icao, iata, name in incoming:
        by_iata = [r for r in stored if iata is not None and r[1] == iata]
        by_icao = [r for r in stored if icao is not None and r[0] == icao]
        if by_iata and by_icao and by_iata[0] is not by_icao[0]:
            return None
        hit = (by_iata or by_icao or [None])[0]
        if hit:
            hit[2] = name
        else:
            stored.append([icao, iata, name])
    return stored


def loaded(spark, existing, incoming):
    def frame(rows):
        full = [(i, f"{i:03d}", icao, iata, name, *[None] * 6) for i, (icao, iata, name) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    result = upsert_airports(frame(existing).select(*AIRPORT.names), frame(incoming))
    return [[r.icao_code, r.iata_code, r.name] for r in result.collect()]


def check(spark, existing, incoming):
    expected = modelled(existing, incoming)
    if expected is None:
        return
    assert sorted(loaded(spark, existing, incoming), key=str) == sorted(expected, key=str)


def test_known_cases(spark):
    existing = [("K1", "A1", "one"), (None, "A2", "two"), ("K3", None, "three"), (None, None, "none")]
    check(spark, existing, [("K9", "A1", "by iata"), ("K3", "A9", "by icao"), (None, "A2", None), (None, None, "again")])
    # Later documents of one batch update the row that an earlier one inserted.
    check(spark, [], [("K1", "A1", "a"), ("K1", "A1", "b"), ("K1", None, "c"), (None, "A1", "d"), ("K2", "A1", "e")])
    # The second row folds into the first, so the third finds its IATA code free.
    check(spark, [], [("K1", "A1", "a"), ("K1", "A2", "b"), ("K2", "A2", "c"), ("K2", "A3", "d"), ("K3", "A3", "e")])
    assert loaded(spark, existing, []) == [list(row) for row in existing] or sorted(
        loaded(spark, existing, []), key=str) == sorted(map(list, existing), key=str)


code = lambda letter: st.one_of(st.none(), st.sampled_from([f"{letter}{i}" for i in range(4)]))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True)
@given(st.lists(st.tuples(code("K"), code("A")), min_size=2, max_size=7))
def test_random_batches(spark, codes):
    incoming = [(icao, iata, f"n{i}") for i, (icao, iata) in enumerate(codes)]
    check(spark, [("K0", "A0", "old"), (None, None, "blank")], incoming)


def test_loading_again_changes_nothing(spark):
    rows = [("K1", "A1", "a"), ("K2", "A2", "b")]
    once = loaded(spark, [], rows)
    assert sorted(loaded(spark, [tuple(r) for r in once], rows), key=str) == sorted(once, key=str)
