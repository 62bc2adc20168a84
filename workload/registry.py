"""Every operator as a query over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.operators import airports as A
from skyloom.operators import delays as D
from skyloom.operators import movements as M
from skyloom.plans import airlines, display, etl, fleet, network, operations, routes
from skyloom.schemas import TIME_COLUMNS
from skyloom.session import materialise, shared_dir
from skyloom.sources import feeds, layout, tables as stored
from workload import tables as T

QUERIES: dict = {}

# The airport that the one-airport forms of the reports select.
AT = "N02"


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, for comparison with another engine."""
    decimals = {f.name: F.col(f.name).cast("double") for f in df.schema if f.dataType.typeName() == "decimal"}
    return df.withColumns(decimals) if decimals else df


def _report(name: str, build) -> None:
    needed = list(signature(build).parameters)
    QUERIES[name] = lambda spark, sf: _plain(build(*[getattr(T, table)(spark, sf) for table in needed]))


# Reports. The argument names of each lambda name the tables it reads.
_report("r01_airport_list", lambda airport: network.airport_list(airport))
_report("r02_manufacturer_share", lambda flights, aircraft: fleet.manufacturer_share(flights, aircraft))
_report("r02_manufacturer_share_at", lambda flights, aircraft: fleet.manufacturer_share(flights, aircraft, AT))
_report("r03_models_by_manufacturer", lambda flights, aircraft: fleet.models_by_manufacturer(flights, aircraft, "red"))
_report("r03_models_by_manufacturer_at",
        lambda flights, aircraft: fleet.models_by_manufacturer(flights, aircraft, "red", AT))
_report("r04_model_usage", lambda flights, aircraft: fleet.model_usage(flights, aircraft))
_report("r04_model_usage_at", lambda flights, aircraft: fleet.model_usage(flights, aircraft, AT))
_report("r05_busy_aircraft", lambda flights, aircraft: fleet.busy_aircraft(flights, aircraft, 9))
_report("r06_frequent_routes", lambda flights: operations.frequent_routes(flights, min_flights=39))
_report("r06_frequent_routes_at", lambda flights: operations.frequent_routes(flights, AT))
_report("r07_top_origins", lambda flights: operations.top_origins(flights))
_report("r07_top_origins_at", lambda flights: operations.top_origins(flights, AT))
_report("r08_flight_classification", lambda flights: operations.flight_classification(flights))
_report("r08_flight_classification_at", lambda flights: operations.flight_classification(flights, AT))
_report("r09_recent_arrivals", lambda flights: operations.recent_arrivals(flights))
_report("r09_recent_arrivals_at", lambda flights: operations.recent_arrivals(flights, AT))
_report("r10_outbound_only_routes", lambda flights: routes.outbound_only_routes(flights))
_report("r10_outbound_only_routes_at", lambda flights: routes.outbound_only_routes(flights, AT))
_report("r11_airline_performance", lambda flights, aircraft: airlines.airline_performance(flights, aircraft))
_report("r11_airline_performance_at", lambda flights, aircraft: airlines.airline_performance(flights, aircraft, AT))
_report("r12_cancelled_flights", lambda flights, airport: operations.cancelled_flights(flights, airport))
_report("r12_cancelled_flights_at", lambda flights, airport: operations.cancelled_flights(flights, airport, AT))
_report("r13_route_diversity", lambda flights, aircraft: routes.route_diversity(flights, aircraft, min_models=20))
_report("r13_route_diversity_at", lambda flights, aircraft: routes.route_diversity(flights, aircraft, AT))
_report("r14_delay_sources", lambda flights: operations.delay_sources(flights))
_report("r14_delay_sources_at", lambda flights: operations.delay_sources(flights, AT))
_report("r15_top_model_by_airline", lambda flights, aircraft: fleet.top_model_by_airline(flights, aircraft))
_report("r16_route_segments", lambda flights, airport: network.route_segments(flights, airport))
_report("r17_active_airports", lambda flights, airport: network.active_airports(flights, airport))
_report("r18_airport_position", lambda airport: network.airport_position(airport, AT))
_report("r18_airport_position_unknown", lambda airport: network.airport_position(airport, "???"))
_report("r19_outbound_destinations", lambda flights, airport: network.outbound_destinations(flights, airport, AT))
_report("r20_inbound_origins", lambda flights, airport: network.inbound_origins(flights, airport, "N15"))
_report("r21_has_data", lambda airport: network.data_present(airport))

# Finished tables.
_report("p01_percent_share", lambda flights, aircraft: display.with_percent_share(
    fleet.manufacturer_share(flights, aircraft), "total_flights"))
_report("p02_status_percentages", lambda flights, aircraft: display.status_percentages(
    airlines.airline_performance(flights, aircraft)))
_report("p03_classification_counts", lambda flights: display.classification_counts(
    operations.flight_classification(flights)))
_report("p04_top_n_models", lambda flights, aircraft: display.top_n_models(fleet.model_usage(flights, aircraft)))
_report("p05_route_label", lambda flights, aircraft: display.route_label(
    routes.route_diversity(flights, aircraft, min_models=0)))
_report("p06_fill_display", lambda flights: display.fill_display(routes.outbound_only_routes(flights)))
_report("p06_fill_display_cancelled", lambda flights, airport: display.fill_display(
    operations.cancelled_flights(flights, airport), display.NOT_AVAILABLE))
_report("p07_display_names", lambda flights, aircraft: display.display_names(
    fleet.top_model_by_airline(flights, aircraft), "top_model_by_airline"))
_report("p08_polyline_vertices", lambda flights, airport: display.polyline_vertices(
    _plain(network.route_segments(flights, airport))))
_report("p08_polyline_vertices_at", lambda flights, airport: display.polyline_vertices(_plain(
    network.airport_segments(
        network.outbound_destinations(flights, airport, AT), network.airport_position(airport, AT)))))
_report("p08_polyline_vertices_inbound", lambda flights, airport: display.polyline_vertices(_plain(
    network.airport_segments(
        network.inbound_origins(flights, airport, "N15"), network.airport_position(airport, "N15")))))
_report("p01_percent_share_models", lambda flights, aircraft: display.with_percent_share(
    fleet.models_by_manufacturer(flights, aircraft, "red"), "total_flights"))
_report("r05_busy_aircraft_default", lambda flights, aircraft: fleet.busy_aircraft(flights, aircraft))
_report("p09_airport_labels", lambda airport: display.airport_labels(network.airport_list(airport)))
_report("p10_percent_text", lambda flights: display.percent_text(operations.delay_sources(flights)))
_report("p11_point_labels", lambda flights, airport: display.point_labels(
    network.outbound_destinations(flights, airport, AT),
    network.inbound_origins(flights, airport, AT),
    network.airport_position(airport, AT),
    AT))


# ETL steps.
_IDS = ["airport_iata", "ingest_seq", "doc_id", "movement_type", "pos"]


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    return M.normalise_movement(M.explode_feed(T.feed(spark, sf)))


def _cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return M.clean_movements(T.feed(spark, sf), A.airport_defaults(spark))


@query("t01_explode_feed")
def explode_feed(spark, sf):
    return M.explode_feed(T.feed(spark, sf)).select(*_IDS, "movement_rank", "number", "status")


@query("t02_normalise_movement")
def normalise_movement(spark, sf):
    return _normalised(spark, sf).select(
        *_IDS,
        F.col("departure.airport.iata").alias("origin_iata"),
        F.col("arrival.airport.iata").alias("destination_iata"),
        F.col("departure.scheduledTime.utc").alias("departure_text"),
        F.col("arrival.scheduledTime.utc").alias("arrival_text"),
    )


@query("t03_fill_airport_defaults")
def fill_airport_defaults(spark, sf):
    filled = M.fill_airport_defaults(M.project_flights(_normalised(spark, sf)), A.airport_defaults(spark))
    fields = ["icao", "iata", "name", "country_code"]
    return filled.select(*_IDS, *[f"{end}_{field}" for end in ["origin", "destination"] for field in fields])


@query("t04_extend_airport_defaults")
def extend_airport_defaults(spark, sf):
    return A.extend_airport_defaults(A.airport_defaults(spark), A.build_airport(T.airport_docs(spark, sf)))


@query("t05_project_flights")
def project_flights(spark, sf):
    return M.project_flights(_normalised(spark, sf)).drop("movement_rank")


@query("t06_ensure_columns")
def ensure_columns(spark, sf):
    narrow = T.flights(spark, sf).select("flight_number", "status")
    return M.ensure_columns(narrow, {"status": "string", "airline_name": "string", "delay_min": "double"})


@query("t07_parse_utc")
def parse_utc(spark, sf):
    return M.parse_utc(M.project_flights(_normalised(spark, sf))).select(*_IDS, *TIME_COLUMNS)


@query("t08_sql_safe")
def sql_safe(spark, sf):
    fraction = F.make_dt_interval(secs=F.lit(0.75))
    rows = T.flights(spark, sf).select(
        "flight_number",
        "scheduled_arrival_utc",
        (F.col("actual_arrival_utc") + fraction).alias("actual_arrival_utc"),
        F.when(F.col("status") == "Canceled", F.lit(float("nan"))).otherwise(F.lit(1.5)).alias("weight"),
    )
    return M.sql_safe(rows, as_text=True)


@query("t09_derive_manufacturer")
def derive_manufacturer(spark, sf):
    rows = M.project_flights(_normalised(spark, sf))
    return M.derive_manufacturer(rows).select(*_IDS, "aircraft_model", "aircraft_manufacturer")


@query("t10_build_flights")
def build_flights(spark, sf):
    return M.build_flights(_cleaned(spark, sf))


@query("t11_build_aircraft")
def build_aircraft(spark, sf):
    return M.build_aircraft(_cleaned(spark, sf))


@query("t12_build_airport")
def build_airport(spark, sf):
    return _plain(A.build_airport(T.airport_docs(spark, sf))).withColumn("missing", F.array_join("missing", ","))


_DELAY = [
    "airport_iata", "ingest_seq", "flight_number", "status", "origin_name", "destination_name",
    "sched_time", "actual_time", "delay_date", "delay_min", "is_delayed", "is_canceled",
]


@query("t13_compute_delays")
def compute_delays(spark, sf):
    return D.compute_delays(_cleaned(spark, sf)).select(*_DELAY)


@query("t14_dedupe_codeshares")
def dedupe_codeshares(spark, sf):
    return D.dedupe_codeshares(D.compute_delays(_cleaned(spark, sf))).select(*_DELAY)


@query("t15_delay_summary")
def delay_summary(spark, sf):
    return D.daily_delays(_cleaned(spark, sf))


def _archive(spark: SparkSession, sf: str, airports: DataFrame | None = None) -> str:
    root = shared_dir(spark, "feeds")
    feeds.archive_feed(T.feed(spark, sf), f"{root}/flights", syncs_per_folder=32)
    (T.airport_json(spark, sf) if airports is None else airports).select("json").write.text(f"{root}/airports")
    return root


@query("t16_run_etl")
def run_etl(spark, sf):
    return etl.run_etl(spark, _archive(spark, sf), shared_dir(spark, "tables")).airport_delays


@query("t16_run_etl_airports")
def run_etl_airports(spark, sf):
    return _plain(etl.run_etl(spark, _archive(spark, sf), shared_dir(spark, "tables")).airport)


@query("t16_run_etl_at")
def run_etl_at(spark, sf):
    return etl.run_etl(
        spark, _archive(spark, sf), shared_dir(spark, "tables"), airports=["LHR", "SFO", "C000030"], since=5, until=20).flights


@query("t16_run_etl_skipped")
def run_etl_skipped(spark, sf):
    return etl.run_etl(spark, _archive(spark, sf), shared_dir(spark, "tables")).skipped


@query("t16_sync_documents")
def sync_documents(spark, sf):
    """Which of its airport's many documents each sync goes with."""
    docs = T.airport_history(spark, sf).selectExpr("ingest_seq", "doc_id", "parse_json(json) AS doc")
    syncs = T.feed(spark, sf).filter("size(arrivals) + size(departures) > 0").select("airport_iata", "ingest_seq")
    return etl.sync_documents(syncs, A.build_airport(docs))


@query("t16_run_etl_resynced")
def run_etl_resynced(spark, sf):
    """Airports whose documents are accepted at one sync and rejected at another: flights are kept sync by sync."""
    return etl.run_etl(spark, _archive(spark, sf, T.airport_history(spark, sf)), shared_dir(spark, "tables")).flights


@query("t16_run_etl_resynced_airports")
def run_etl_resynced_airports(spark, sf):
    return _plain(etl.run_etl(spark, _archive(spark, sf, T.airport_history(spark, sf)), shared_dir(spark, "tables")).airport)


@query("t16_run_etl_replaced")
def run_etl_replaced(spark, sf):
    """Some airports' syncs loaded twice, then all of them once more in place of what is stored: one copy of each."""
    feed, root = _archive(spark, sf), shared_dir(spark, "tables")
    for airports, repeat in ((["LHR", "SFO", "C000030"], "append"), (["LHR", "C000030"], "append"), (None, "replace")):
        loaded = etl.run_etl(spark, feed, root, airports=airports, repeat=repeat)
    return loaded.flights


# Sources and sinks.
@query("s01_read_flight_feed")
def read_flight_feed(spark, sf):
    path = shared_dir(spark, "feed")
    feeds.archive_feed(T.feed(spark, sf), path, syncs_per_folder=32)
    return M.project_flights(M.normalise_movement(M.explode_feed(feeds.read_flight_feed(spark, path)))).drop(
        "movement_rank"
    )


@query("s02_read_airport_feed")
def read_airport_feed(spark, sf):
    path = shared_dir(spark, "airports")
    T.airport_json(spark, sf).select("json").write.text(path)
    return feeds.read_airport_feed(spark, path).select(
        "ingest_seq",
        "doc_id",
        F.variant_get("doc", "$.iata", "string").alias("iata"),
        F.variant_get("doc", "$.fullName", "string").alias("full_name"),
        F.variant_get("doc", "$.country.code", "string").alias("country_code"),
        F.variant_get("doc", "$.location.lat", "double").alias("lat"),
        F.variant_get("doc", "$.timeZone", "string").alias("time_zone"),
    )


@query("s03_read_tables")
def read_tables(spark, sf):
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    named = T.airport(spark, sf).withColumns({"ingest_seq": F.lit(1), "doc_id": F.col("icao_code")})
    stored.load_airports(named, root)
    stored.append_flights(T.flights(spark, sf), root)
    stored.insert_new_aircraft(T.aircraft(spark, sf), root)
    stored.read_tables(spark, root, views=True)
    return spark.sql("""
        SELECT o.country, a.aircraft_manufacturer, count(*) AS listings,
               count(f.actual_departure_utc) AS departed, min(f.scheduled_departure_utc) AS first_departure
        FROM flights f
        JOIN airport o ON f.origin_iata = o.iata_code
        JOIN aircraft a ON f.aircraft_registration = a.aircraft_registration
        GROUP BY o.country, a.aircraft_manufacturer
    """)


@query("s04_upsert_airports")
def upsert_airports(spark, sf):
    existing = T.table(spark, sf, "customer").selectExpr(
        "CASE WHEN c_custkey % 10 <> 8 THEN 'K' || c_custkey END AS icao_code",
        "CASE WHEN c_custkey % 10 <> 7 THEN 'X' || c_custkey END AS iata_code",
        "c_name AS name", "c_mktsegment AS city", "'Country ' || c_nationkey AS country", "'Old' AS continent",
        "CAST(c_nationkey AS DECIMAL(10, 8)) AS latitude", "CAST(c_nationkey AS DECIMAL(11, 8)) AS longitude",
        "'UTC' AS timezone",
    )
    incoming = T.table(spark, sf, "supplier").selectExpr(
        "bigint(s_suppkey % 3) AS ingest_seq", "lpad(s_suppkey, 12, '0') AS doc_id",
        "CASE s_suppkey % 5 WHEN 0 THEN 'Z' || s_suppkey WHEN 1 THEN 'K' || s_suppkey div 5 * 3 "
        "WHEN 2 THEN 'W' || s_suppkey div 10 END AS icao_code",
        "CASE s_suppkey % 5 WHEN 0 THEN 'X' || s_suppkey div 5 * 3 WHEN 2 THEN 'Y' || s_suppkey div 10 "
        "WHEN 4 THEN 'V' || s_suppkey END AS iata_code",
        "s_name AS name", "CASE WHEN s_suppkey % 3 <> 0 THEN 'City ' || s_suppkey END AS city",
        "'Country ' || s_nationkey AS country", "'New' AS continent",
        "CAST(s_nationkey AS DECIMAL(10, 8)) AS latitude", "CAST(s_nationkey AS DECIMAL(11, 8)) AS longitude",
        "CASE WHEN s_suppkey % 7 <> 0 THEN 'UTC+1' END AS timezone",
    )
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    stored.load_airports(existing.selectExpr("0L AS ingest_seq", "name AS doc_id", "*"), root)
    stored.load_airports(incoming, root)
    return _plain(stored.read_tables(spark, root).airport)


@query("s04_upsert_airports_chains")
def upsert_airports_chains(spark, sf):
    """Documents that contradict each other about which codes belong together, in chains of 200."""
    docs = T.table(spark, sf, "customer").selectExpr("*", "(c_custkey - 1) div 200 AS chain", "(c_custkey - 1) % 200 AS i").selectExpr(
        "1L AS ingest_seq", "lpad(c_custkey, 12, '0') AS doc_id",
        "'K' || chain || '-' || (i + 1) div 2 AS icao_code", "'A' || chain || '-' || i div 2 AS iata_code",
        "c_name AS name", "c_mktsegment AS city", "'Country ' || c_nationkey AS country", "'None' AS continent",
        "CAST(c_nationkey AS DECIMAL(10, 8)) AS latitude", "CAST(c_nationkey AS DECIMAL(11, 8)) AS longitude", "'UTC' AS timezone")
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    stored.load_airports(docs, root)
    return _plain(stored.read_tables(spark, root).airport)


def _loaded_twice(spark: SparkSession, sf: str, dedupe_keys=None) -> DataFrame:
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    rows = materialise(M.parse_utc(M.project_flights(_normalised(spark, sf))))
    for _ in range(2):
        stored.append_flights(rows, root, dedupe_keys)
    return stored.read_tables(spark, root).flights


@query("s05_append_flights")
def append_flights(spark, sf):
    return _loaded_twice(spark, sf)


@query("s05_append_flights_deduped")
def append_flights_deduped(spark, sf):
    return _loaded_twice(spark, sf, ["flight_number", "scheduled_departure_utc"])


@query("s05_compact_flights")
def compact_flights(spark, sf):
    """Flights appended in five small loads, then merged into one."""
    root, flights = shared_dir(spark, "tables"), T.flights(spark, sf)
    stored.create_tables(spark, root)
    for part in range(5):
        stored.append_flights(flights.filter(F.pmod(F.dayofyear("scheduled_departure_utc"), F.lit(5)) == part), root)
    stored.compact(spark, root)
    return stored.read_tables(spark, root).flights.groupBy("origin_iata", "destination_iata").agg(
        F.count("*").alias("flights"), F.count("actual_arrival_utc").alias("arrived"), F.min("scheduled_departure_utc").alias("first"))


@query("s05_clustered_flights_at")
def clustered_flights_at(spark, sf):
    """The flights of one airport, from the copy that is clustered by both ends."""
    path = shared_dir(spark, "clustered")
    layout.write_clustered(T.flights(spark, sf), path)
    return operations.top_origins(layout.read_clustered(spark, path), AT)


@query("s06_insert_new_aircraft")
def insert_new_aircraft(spark, sf):
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    cleaned = materialise(_cleaned(spark, sf))
    stored.insert_new_aircraft(M.build_aircraft(cleaned.filter("ingest_seq >= 14")), root)
    stored.insert_new_aircraft(M.build_aircraft(cleaned), root)
    return stored.read_tables(spark, root).aircraft


@query("s06_insert_new_aircraft_long")
def insert_new_aircraft_long(spark, sf):
    """Registrations beyond the column's width, repeated within and across two batches, come back whole and once."""
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    long = T.table(spark, sf, "lineitem").selectExpr(
        "'FL' || l_suppkey AS flight_number", "repeat('R', 20) || l_partkey AS aircraft_registration",
        "repeat('Model ', 30) || l_partkey % 50 AS aircraft_model", "'AL' || l_suppkey % 20 AS airline_code_icao",
        "'A' || l_suppkey % 20 AS airline_code_iata", "'Airline ' || l_suppkey % 30 AS airline_name",
        "'Model' AS aircraft_manufacturer", "bigint(l_orderkey) AS ingest_seq", "0 AS movement_rank",
        "lpad(l_suppkey, 12, '0') AS doc_id", "l_linenumber AS pos")
    stored.insert_new_aircraft(long.filter("ingest_seq % 2 = 0"), root)
    stored.insert_new_aircraft(long, root)
    return stored.read_tables(spark, root).aircraft


@query("s07_append_delays")
def append_delays(spark, sf):
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    summary = materialise(delay_summary(spark, sf))
    for _ in range(2):
        stored.append_delays(summary, root)
    return stored.read_tables(spark, root).airport_delays


@query("s08_catalog_tables")
def catalog_tables(spark, sf):
    """Two loads through the catalog: the newest airports, and flights as soon as they are appended."""
    root, database = shared_dir(spark, "tables"), f"flights_{uuid.uuid4().hex}"
    stored.create_tables(spark, root, database)
    named = T.airport(spark, sf).withColumns({"ingest_seq": F.lit(1), "doc_id": F.col("icao_code")})
    for _ in range(2):
        stored.load_airports(named, root, database)
    stored.append_flights(T.flights(spark, sf), root, database=database)
    counted = spark.table(f"{database}.flights").groupBy("origin_iata").agg(F.count("*").alias("flights"))
    return spark.table(f"{database}.airport").join(counted, F.col("iata_code") == F.col("origin_iata")).select(
        "iata_code", "name", "flights")


@query("s08_create_tables")
def create_tables(spark, sf):
    root = shared_dir(spark, "tables")
    stored.create_tables(spark, root)
    stored.insert_new_aircraft(T.aircraft(spark, sf), root)
    stored.create_tables(spark, root)
    return stored.read_tables(spark, root).aircraft
