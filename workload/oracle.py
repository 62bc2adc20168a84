"""The same results in DuckDB SQL, written independently of the Spark plans."""

from __future__ import annotations

AT = "N02"

_FLIGHTS = """
ring AS (
    SELECT *, l_orderkey % 25 AS o, 1 + (l_orderkey // 25) % 15 AS step,
        TIMESTAMP '2025-01-01' + to_minutes(CAST(l_orderkey * 7919 % 525600 AS BIGINT)) AS departs,
        to_minutes(CAST(l_quantity AS BIGINT) - 25) AS shift
    FROM lineitem
), scheduled AS (
    SELECT *, (o + step) % 28 AS d,
        CASE WHEN l_linenumber <> 7 OR l_quantity >= 5 THEN departs + to_hours(CAST(2 + step AS BIGINT)) END AS arrives
    FROM ring
), flights AS (
    SELECT
        CASE WHEN l_linenumber <> 1 OR l_quantity <> 50
            THEN concat('FL', l_suppkey, '-', l_partkey % 50) END AS flight_number,
        CASE WHEN l_discount <> 0 THEN concat('REG', l_partkey) END AS aircraft_registration,
        printf('I%03d', o) AS origin_icao, printf('N%02d', o) AS origin_iata,
        concat('NATION_', o) AS origin_name, CAST(o % 5 AS VARCHAR) AS origin_country_code,
        printf('I%03d', d) AS destination_icao,
        CASE WHEN l_discount <= 0.095 OR l_tax <= 0.075 THEN printf('N%02d', d) END AS destination_iata,
        CASE WHEN d <> 27 THEN concat('NATION_', d) END AS destination_name,
        CASE WHEN d <> 26 THEN CAST(d % 5 AS VARCHAR) END AS destination_country_code,
        departs AS scheduled_departure_utc,
        CASE WHEN l_tax <> 0 THEN departs + shift END AS actual_departure_utc,
        arrives AS scheduled_arrival_utc,
        CASE WHEN l_tax <> 0 AND l_returnflag <> 'R' THEN arrives + shift END AS actual_arrival_utc,
        CASE l_returnflag WHEN 'R' THEN CASE WHEN l_quantity > 45 THEN 'CanceledUncertain' ELSE 'Canceled' END
            WHEN 'A' THEN 'Delayed' ELSE 'Arrived' END AS status,
        CASE l_linestatus WHEN 'F' THEN 'Arrival' ELSE 'Departure' END AS movement_type,
        concat('A', l_suppkey % 20) AS airline_code_iata, concat('AL', l_suppkey % 20) AS airline_code_icao
    FROM scheduled
)"""

_AIRCRAFT = """
aircraft AS (
    SELECT concat('FL', p_partkey // 20, '-', p_partkey % 50) AS flight_number,
        concat('REG', p_partkey) AS aircraft_registration,
        CASE WHEN p_size <> 2 THEN concat(p_name, ' ', p_type) END AS aircraft_model,
        concat('AL', p_partkey % 20) AS airline_code_icao, concat('A', p_partkey % 20) AS airline_code_iata,
        CASE WHEN p_size <> 1 THEN concat('Airline ', p_partkey % 30) END AS airline_name,
        CASE WHEN p_size <> 2 THEN split_part(p_name, ' ', 1) END AS aircraft_manufacturer
    FROM part
)"""

_AIRPORT = """
airport AS (
    SELECT printf('I%03d', n_nationkey) AS icao_code, printf('N%02d', n_nationkey) AS iata_code,
        n_name AS name, n_name AS city, r_name AS country, r_name AS continent,
        CAST(n_nationkey * 5 - 60 AS DOUBLE) AS latitude, CAST(n_nationkey * 13 - 150 AS DOUBLE) AS longitude,
        'UTC' AS timezone
    FROM nation, region WHERE n_regionkey = r_regionkey
    UNION ALL
    SELECT printf('K%09d', c_custkey), concat('X', c_custkey), c_name, c_mktsegment, concat('NATION_', c_nationkey),
        'None', CAST(c_nationkey * 2 - 20 AS DOUBLE), CAST(c_nationkey * 7 - 80 AS DOUBLE), 'UTC'
    FROM customer
)"""

_BASE = f"WITH {_FLIGHTS}, {_AIRCRAFT}, {_AIRPORT}"

# One row per physical flight: departures by lowest flight number.
_DEPARTURES = """
departures AS (
    SELECT DISTINCT ON (origin_iata, destination_iata, scheduled_departure_utc) *
    FROM flights WHERE movement_type = 'Departure' AND {where}
    ORDER BY origin_iata, destination_iata, scheduled_departure_utc, flight_number NULLS FIRST,
        origin_name NULLS FIRST, destination_name NULLS FIRST, origin_country_code NULLS FIRST,
        destination_country_code NULLS FIRST
)"""

_PHYSICAL = """
physical AS (
    SELECT (SELECT aircraft_model FROM aircraft a WHERE a.aircraft_registration = g.reg) AS model, reg
    FROM (SELECT min(aircraft_registration) AS reg FROM flights WHERE {where}
          GROUP BY scheduled_departure_utc, origin_iata, destination_iata) g
    WHERE reg IN (SELECT aircraft_registration FROM aircraft)
)"""

_ENDS = f"(origin_iata = '{AT}' OR destination_iata = '{AT}')"
_FROM = f"origin_iata = '{AT}'"
_TO = f"destination_iata = '{AT}'"

_MANUFACTURERS = """
SELECT aircraft_manufacturer, count(*) AS total_flights
FROM flights JOIN aircraft USING (aircraft_registration) WHERE {where} GROUP BY ALL"""
_MODELS = """
SELECT aircraft_model, count(*) AS total_flights
FROM flights JOIN aircraft USING (aircraft_registration)
WHERE aircraft_manufacturer = 'red' AND {where} GROUP BY ALL"""
_USAGE = f", {_PHYSICAL} SELECT model AS aircraft_model, count(*) AS total_flights FROM physical GROUP BY ALL"
_FREQUENT = """
SELECT origin_name, destination_name, count(*) AS outbound_flights FROM (
    SELECT DISTINCT origin_name, destination_name, scheduled_departure_utc, scheduled_arrival_utc FROM flights
    WHERE {where} AND destination_name IS NOT NULL AND scheduled_arrival_utc IS NOT NULL) t
GROUP BY ALL HAVING count(*) > {least}"""
_TOP_ORIGINS = """
SELECT origin_name AS origin_airport, origin_iata AS "IATA", count(*) AS total_flights FROM (
    SELECT DISTINCT origin_name, origin_iata, flight_number, scheduled_arrival_utc FROM flights
    WHERE movement_type = 'Arrival' AND {where} AND flight_number IS NOT NULL
        AND scheduled_arrival_utc IS NOT NULL) t
GROUP BY ALL ORDER BY total_flights DESC, origin_airport NULLS FIRST, "IATA" NULLS FIRST LIMIT 3"""
_CLASSES = f""", {_DEPARTURES}
SELECT flight_number, origin_name AS origin, destination_name AS destination,
    CASE WHEN origin_country_code = destination_country_code THEN 'Domestic' ELSE 'International' END AS flight_type
FROM departures"""
_RECENT = """
SELECT flight_number, origin_name AS departure_airport, destination_name AS origin_airport,
    actual_arrival_utc AS arrival_time
FROM (SELECT DISTINCT ON (origin_iata, destination_iata, actual_arrival_utc) *
      FROM flights WHERE movement_type = 'Arrival' AND {where}
      ORDER BY origin_iata, destination_iata, actual_arrival_utc, flight_number NULLS FIRST,
          origin_name NULLS FIRST, destination_name NULLS FIRST) t
ORDER BY actual_arrival_utc DESC NULLS LAST, flight_number NULLS FIRST, origin_iata NULLS FIRST,
    destination_iata NULLS FIRST LIMIT 5"""
_ONE_WAY_ALL = """
SELECT DISTINCT origin_name, origin_iata AS origin_airport_code, destination_name,
    destination_iata AS destination_airport_code
FROM flights f WHERE origin_iata IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM (SELECT DISTINCT origin_iata AS bo, destination_iata AS bd FROM flights) back
    WHERE back.bo = f.destination_iata AND back.bd = f.origin_iata)"""
_ONE_WAY_AT = f"""
SELECT DISTINCT origin_name, origin_iata AS origin_airport_code, destination_name,
    destination_iata AS destination_airport_code
FROM flights WHERE {_FROM} AND destination_iata NOT IN (
    SELECT origin_iata FROM flights WHERE {_TO} AND origin_iata IS NOT NULL)"""
_PERFORMANCE = """, arrived AS (
    SELECT DISTINCT ON (origin_iata, destination_iata, scheduled_arrival_utc) *
    FROM flights
    WHERE movement_type = 'Arrival' AND status <> 'CanceledUncertain' AND {where}
    ORDER BY origin_iata, destination_iata, scheduled_arrival_utc, actual_arrival_utc DESC NULLS LAST,
        flight_number NULLS FIRST, airline_code_iata NULLS FIRST, status NULLS FIRST
), performance AS (
    SELECT al.airline_name, f.airline_code_iata,
        count(*) FILTER (status <> 'Canceled' AND actual_arrival_utc <= scheduled_arrival_utc) AS on_time_flights,
        count(*) FILTER (status = 'Delayed' OR (status <> 'Canceled' AND actual_arrival_utc > scheduled_arrival_utc))
            AS delayed_flights,
        count(*) FILTER (status = 'Canceled') AS cancelled_flights
    FROM arrived f JOIN (SELECT DISTINCT airline_code_iata, airline_name FROM aircraft) al
        ON al.airline_code_iata = f.airline_code_iata
    GROUP BY ALL
)"""
_CANCELLED = """
SELECT flight_number, aircraft_registration AS aircraft, o.name AS origin_airport, d.name AS destination_airport,
    scheduled_departure_utc
FROM (SELECT DISTINCT ON (origin_iata, destination_iata, scheduled_departure_utc) *
      FROM flights WHERE status = 'Canceled' AND {where}
      ORDER BY origin_iata, destination_iata, scheduled_departure_utc, flight_number NULLS FIRST,
          aircraft_registration NULLS FIRST) c
JOIN airport o ON o.iata_code = c.origin_iata JOIN airport d ON d.iata_code = c.destination_iata"""
_DIVERSITY = f""", {_DEPARTURES}
SELECT f.origin_name, f.destination_name, count(DISTINCT a.aircraft_model) AS aircraft_model_count
FROM departures f JOIN aircraft a ON a.flight_number = f.flight_number
GROUP BY ALL HAVING count(DISTINCT a.aircraft_model) > {{least}}"""
_DELAY_SOURCES = """
SELECT origin_name AS origin_airport, origin_iata AS iata_code,
    count(DISTINCT CASE WHEN actual_arrival_utc > scheduled_arrival_utc
        THEN concat(flight_number, '@', scheduled_arrival_utc) END) * 100.0::DOUBLE
        / count(DISTINCT concat(flight_number, '@', scheduled_arrival_utc)) AS percent_delayed,
    count(DISTINCT concat(flight_number, '@', scheduled_arrival_utc)) AS total_flights
FROM flights
WHERE movement_type = 'Arrival' AND status = 'Arrived' AND {where} AND flight_number IS NOT NULL
    AND scheduled_arrival_utc IS NOT NULL
GROUP BY ALL HAVING total_flights > 2
ORDER BY percent_delayed DESC, origin_airport NULLS FIRST, iata_code NULLS FIRST LIMIT 10"""
_TOP_MODEL = """
SELECT airline_name, aircraft_model, count(*) AS flight_count
FROM flights JOIN aircraft USING (aircraft_registration)
WHERE airline_name IS NOT NULL AND aircraft_model IS NOT NULL
GROUP BY airline_name, aircraft_model
QUALIFY row_number() OVER (PARTITION BY airline_name ORDER BY count(*) DESC, aircraft_model) = 1"""
_SEGMENTS = """
SELECT DISTINCT o.latitude AS origin_lat, o.longitude AS origin_lon, d.latitude AS dest_lat, d.longitude AS dest_lon
FROM (SELECT DISTINCT origin_iata, destination_iata FROM flights) f
JOIN airport o ON o.iata_code = f.origin_iata JOIN airport d ON d.iata_code = f.destination_iata"""
_PARTNERS = """
SELECT a.name, a.latitude, a.longitude, count(f.flight_number) AS count
FROM flights f JOIN airport a ON a.iata_code = f.{other} WHERE f.{own} = '{iata}' GROUP BY ALL"""
_OUTBOUND = _PARTNERS.format(other="destination_iata", own="origin_iata", iata=AT)
_INBOUND = _PARTNERS.format(other="origin_iata", own="destination_iata", iata=AT)

_PERCENT = "printf('%.1f%%', round_even({}, 1))"

_VERTICES = """
SELECT origin_lat, origin_lon, dest_lat, dest_lon, vertex,
    CASE vertex WHEN 0 THEN origin_lat WHEN 1 THEN dest_lat END AS lat,
    CASE vertex WHEN 0 THEN origin_lon WHEN 1 THEN dest_lon END AS lon
FROM segments, (SELECT unnest([0, 1, 2])::INTEGER AS vertex) v"""
_ROUTE_VERTICES = _VERTICES.replace("SELECT origin_lat", "SELECT route, origin_lat", 1)


def _reports() -> dict[str, str]:
    every = {"where": "true"}
    return {
        "r01_airport_list": "SELECT iata_code, name, city FROM airport",
        "r02_manufacturer_share": _MANUFACTURERS.format(**every),
        "r02_manufacturer_share_at": _MANUFACTURERS.format(where=_ENDS),
        "r03_models_by_manufacturer": _MODELS.format(**every),
        "r03_models_by_manufacturer_at": _MODELS.format(where=_ENDS),
        "r04_model_usage": _USAGE.format(**every),
        "r04_model_usage_at": _USAGE.format(where=_ENDS),
        "r05_busy_aircraft": f""", {_PHYSICAL.format(**every)}
            SELECT reg AS aircraft_registration, model AS aircraft_model, count(*) AS total_flights
            FROM physical GROUP BY ALL HAVING count(*) > 9""",
        "r05_busy_aircraft_default": f""", {_PHYSICAL.format(**every)}
            SELECT reg AS aircraft_registration, model AS aircraft_model, count(*) AS total_flights
            FROM physical GROUP BY ALL HAVING count(*) > 5""",
        "r06_frequent_routes": _FREQUENT.format(least=39, **every),
        "r06_frequent_routes_at": _FREQUENT.format(least=5, where=_FROM),
        "r07_top_origins": _TOP_ORIGINS.format(**every),
        "r07_top_origins_at": _TOP_ORIGINS.format(where=_TO),
        "r08_flight_classification": _CLASSES.format(**every),
        "r08_flight_classification_at": _CLASSES.format(where=_FROM),
        "r09_recent_arrivals": _RECENT.format(**every),
        "r09_recent_arrivals_at": _RECENT.format(where=_TO),
        "r10_outbound_only_routes": _ONE_WAY_ALL,
        "r10_outbound_only_routes_at": _ONE_WAY_AT,
        "r11_airline_performance": _PERFORMANCE.format(**every) + " SELECT * FROM performance",
        "r11_airline_performance_at": _PERFORMANCE.format(where=_TO) + " SELECT * FROM performance",
        "r12_cancelled_flights": _CANCELLED.format(**every),
        "r12_cancelled_flights_at": _CANCELLED.format(where=_FROM),
        "r13_route_diversity": _DIVERSITY.format(least=20, **every),
        "r13_route_diversity_at": _DIVERSITY.format(least=2, where=_FROM),
        "r14_delay_sources": _DELAY_SOURCES.format(**every),
        "r14_delay_sources_at": _DELAY_SOURCES.format(where=_TO),
        "r15_top_model_by_airline": _TOP_MODEL,
        "r16_route_segments": _SEGMENTS,
        "r17_active_airports": """SELECT DISTINCT name, latitude, longitude FROM airport
            WHERE iata_code IN (SELECT origin_iata FROM flights) OR iata_code IN (SELECT destination_iata FROM flights)""",
        "r18_airport_position": f"SELECT latitude, longitude FROM airport WHERE iata_code = '{AT}'",
        "r18_airport_position_unknown": """SELECT coalesce(max(latitude), 0) AS latitude,
            coalesce(max(longitude), 0) AS longitude FROM airport WHERE iata_code = '???'""",
        "r19_outbound_destinations": _OUTBOUND,
        "r20_inbound_origins": _PARTNERS.format(other="origin_iata", own="destination_iata", iata="N15"),
        "r21_has_data": "SELECT count(*) > 0 AS has_data FROM airport",
        "p01_percent_share": f"""
            SELECT aircraft_manufacturer, total_flights,
                {_PERCENT.format('total_flights / sum(total_flights) OVER () * 100')} AS "Percentage"
            FROM ({_MANUFACTURERS.format(**every)}) t""",
        "p01_percent_share_models": f"""
            SELECT aircraft_model, total_flights,
                {_PERCENT.format('total_flights / sum(total_flights) OVER () * 100')} AS "Percentage"
            FROM ({_MODELS.format(**every)}) t""",
        "p02_status_percentages": _PERFORMANCE.format(**every) + """, named AS (
            SELECT airline_name, sum(on_time_flights) AS a, sum(delayed_flights) AS b, sum(cancelled_flights) AS c
            FROM performance GROUP BY airline_name)
            SELECT airline_name AS "Airline Name", a * 100.0::DOUBLE / nullif(a + b + c, 0) AS "On-Time",
                b * 100.0::DOUBLE / nullif(a + b + c, 0) AS "Delayed",
                c * 100.0::DOUBLE / nullif(a + b + c, 0) AS "Cancelled" FROM named""",
        "p03_classification_counts": f""", {_DEPARTURES.format(**every)}
            SELECT CASE WHEN origin_country_code = destination_country_code THEN 'Domestic' ELSE 'International' END
                AS "Type", count(*) AS "Count" FROM departures GROUP BY 1""",
        "p04_top_n_models": _USAGE.format(**every)
            + " ORDER BY total_flights DESC, aircraft_model NULLS FIRST LIMIT 10",
        "p05_route_label": _DIVERSITY.format(least=0, **every).replace(
            "SELECT f.origin_name", "SELECT f.origin_name || ' ➔ ' || f.destination_name AS \"Route\", f.origin_name"),
        "p06_fill_display": f"""
            SELECT coalesce(origin_name, '') AS origin_name, coalesce(origin_airport_code, '') AS origin_airport_code,
                coalesce(destination_name, '') AS destination_name,
                coalesce(destination_airport_code, '') AS destination_airport_code FROM ({_ONE_WAY_ALL}) t""",
        "p06_fill_display_cancelled": f"""
            SELECT coalesce(flight_number, 'Not Available') AS flight_number,
                coalesce(aircraft, 'Not Available') AS aircraft,
                coalesce(origin_airport, 'Not Available') AS origin_airport,
                coalesce(destination_airport, 'Not Available') AS destination_airport,
                coalesce(CAST(scheduled_departure_utc AS VARCHAR), 'Not Available') AS scheduled_departure_utc
            FROM ({_CANCELLED.format(**every)}) t""",
        "p07_display_names": f"""SELECT airline_name AS "Airline", aircraft_model AS "Most Used Model",
            flight_count AS "Flights" FROM ({_TOP_MODEL}) t""",
        "p08_polyline_vertices": f", segments AS ({_SEGMENTS}) {_VERTICES}",
        "p08_polyline_vertices_at": f""", segments AS (
            SELECT p.name AS route, h.latitude AS origin_lat, h.longitude AS origin_lon, p.latitude AS dest_lat,
                p.longitude AS dest_lon
            FROM ({_OUTBOUND}) p, airport h WHERE h.iata_code = '{AT}') {_ROUTE_VERTICES}""",
        "p08_polyline_vertices_inbound": f""", segments AS (
            SELECT p.name AS route, h.latitude AS origin_lat, h.longitude AS origin_lon, p.latitude AS dest_lat,
                p.longitude AS dest_lon
            FROM ({_PARTNERS.format(other="origin_iata", own="destination_iata", iata="N15")}) p, airport h
            WHERE h.iata_code = 'N15') {_ROUTE_VERTICES}""",
        "p09_airport_labels": """SELECT 'All Airports (Global View)' AS label, 'ALL' AS iata_code
            UNION ALL SELECT name || ' (' || iata_code || ')', iata_code FROM airport""",
        "p10_percent_text": f"SELECT *, {_PERCENT.format('percent_delayed')} AS text FROM ({_DELAY_SOURCES.format(**every)}) t",
        "p11_point_labels": f"""
            SELECT name || ' (Destination)' AS label, latitude, longitude FROM ({_OUTBOUND}) a
            UNION ALL SELECT name || ' (Origin)', latitude, longitude FROM ({_INBOUND}) b
            UNION ALL SELECT '{AT} (Selected)', latitude, longitude FROM airport WHERE iata_code = '{AT}'""",
        "t06_ensure_columns": """SELECT flight_number, status, CAST(NULL AS VARCHAR) AS airline_name,
            CAST(NULL AS DOUBLE) AS delay_min FROM flights""",
        "t08_sql_safe": """SELECT flight_number,
            strftime(scheduled_arrival_utc, '%Y-%m-%d %H:%M:%S') AS scheduled_arrival_utc,
            strftime(actual_arrival_utc, '%Y-%m-%d %H:%M:%S') AS actual_arrival_utc,
            CASE WHEN status <> 'Canceled' THEN 1.5::DOUBLE END AS weight FROM flights""",
        "s05_clustered_flights_at": _TOP_ORIGINS.format(where=_TO),
        "s05_compact_flights": """SELECT origin_iata, destination_iata, count(*) AS flights, count(actual_arrival_utc) AS arrived,
            min(scheduled_departure_utc) AS first FROM flights GROUP BY ALL""",
        "s03_read_tables": """
            SELECT o.country, a.aircraft_manufacturer, count(*) AS listings, count(f.actual_departure_utc) AS departed,
                min(f.scheduled_departure_utc) AS first_departure
            FROM flights f JOIN airport o ON o.iata_code = f.origin_iata
            JOIN aircraft a ON a.aircraft_registration = f.aircraft_registration GROUP BY ALL""",
        "s08_create_tables": "SELECT * FROM aircraft",
        "s08_catalog_tables": """SELECT iata_code, name, count(*) AS flights FROM airport
            JOIN flights ON origin_iata = iata_code GROUP BY ALL""",
    }


# The built-in airports, as IATA, ICAO, name and country code.
_SEEDS = """
seeds AS (SELECT * FROM (VALUES
    ('DEL', 'VIDP', 'New Delhi Indira Gandhi', 'in'), ('BLR', 'VOBL', 'Banglaore Bengaluru', 'in'),
    ('DXB', 'OMDB', 'Dubai', 'ae'), ('HKG', 'VHHH', 'Hong Kong Chek Lap Kok', 'hk'),
    ('HND', 'RJTT', 'Tokyo Haneda', 'jp'), ('SYD', 'YSSY', 'Sydney Kingsford Smith', 'au'),
    ('SFO', 'KSFO', 'San Francisco', 'us'), ('JFK', 'KJFK', 'New York John F Kennedy', 'us'),
    ('CGH', 'SBSP', 'São Paulo Congonhas', 'br'), ('LHR', 'EGLL', 'London Heathrow', 'gb'),
    ('CDG', 'LFPG', 'Paris Charles de Gaulle', 'fr'), ('JNB', 'FAOR', 'Jo''anna Johannesburg OR Tambo', 'za'),
    ('SIN', 'WSSS', 'Singapore', 'sg')) v(iata, icao, name, country_code))"""

_IATA = ("CASE WHEN {0} < 13 THEN ['DEL', 'BLR', 'DXB', 'HKG', 'HND', 'SYD', 'SFO', 'JFK', 'CGH', 'LHR', 'CDG', 'JNB', "
         "'SIN'][{0} + 1] ELSE printf('C%06d', {0}) END")

_DOCS = f"""
docs AS (
    SELECT c_custkey % 4 AS ingest_seq, printf('%012d', c_custkey) AS doc_id, printf('K%06d', c_custkey) AS icao_code,
        {_IATA.format('c_custkey')} AS iata_code, c_name AS name, c_mktsegment AS city,
        CASE WHEN c_custkey % 11 <> 5 THEN concat('Country ', c_nationkey) END AS country,
        concat('Continent ', c_nationkey % 5) AS continent,
        c_nationkey * 2.5::DOUBLE - 30 AS latitude, c_nationkey * 6.25::DOUBLE - 70 AS longitude,
        CASE WHEN c_custkey % 7 <> 3 THEN 'UTC' END AS timezone,
        CASE WHEN c_custkey % 11 <> 5 THEN lower(c_mktsegment) END AS country_code,
        concat_ws(',', CASE WHEN c_custkey % 11 = 5 THEN 'country' END, CASE WHEN c_custkey % 7 = 3 THEN 'timezone' END)
            AS missing
    FROM customer
), extended AS (
    SELECT iata, icao, name, country_code FROM seeds
    UNION ALL SELECT iata_code, icao_code, name, coalesce(country_code, '') FROM docs
    WHERE iata_code NOT IN (SELECT iata FROM seeds)
)"""

# One row per listed flight, with both the text and the parsed form of its times.
_LISTED = f"""
keyed AS (
    SELECT o_orderkey AS k, o_custkey AS c, o_custkey % 40 AS a, (o_custkey % 40 + 1 + o_orderkey % 5) % 28 AS b,
        date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) // 90 AS ingest_seq
    FROM orders
), placed AS (
    SELECT *, {_IATA.format('a')} AS airport_iata, printf('%012d', k) AS doc_id, k % 4 = 0 AS short,
        TIMESTAMP '1995-01-01' + to_days(CAST(ingest_seq * 90 AS INTEGER)) + to_minutes(k % 2880) AS sched
    FROM keyed
), listed AS (
    SELECT *, 'Arrival' AS movement_type, 0 AS movement_rank, unnest(range(1, k % 3 + 1)) AS i FROM placed
    UNION ALL
    SELECT *, 'Departure', 1, unnest(range(1, (k // 3) % 3 + 1)) FROM placed
), told AS (
    SELECT *, CAST(i - 1 AS INTEGER) AS pos,
        CASE WHEN k % 41 <> 0 THEN concat('FL', k % 500, '-', i) END AS flight_number,
        CASE k % 7 WHEN 0 THEN 'Canceled' WHEN 1 THEN 'CanceledUncertain' WHEN 2 THEN 'Delayed' WHEN 3 THEN NULL
            ELSE 'Arrived' END AS status,
        sched + to_minutes((k * 7 + i * 13) % 90 - 30) + to_seconds(k % 60) AS happened,
        CASE WHEN k % 13 <> 0 THEN concat('R', c * 3 + i) END AS aircraft_registration,
        CASE WHEN k % 9 = 0 THEN NULL WHEN k % 9 = 1 THEN ''
            WHEN k % 9 = 2 THEN concat('  Maker', k % 4, '   M', k % 50)
            ELSE concat('Maker', k % 4, ' M', k % 50) END AS aircraft_model,
        CASE WHEN k % 9 > 1 THEN concat('Maker', k % 4) END AS aircraft_manufacturer,
        concat('Airline ', c % 30) AS airline_name, concat('A', c % 20) AS airline_code_iata,
        concat('AL', c % 20) AS airline_code_icao,
        concat('K', b) AS b_icao, printf('N%02d', b) AS b_iata,
        CASE WHEN b <> 27 THEN concat('City ', b) END AS b_name, CAST(b % 5 AS VARCHAR) AS b_cc,
        CASE WHEN k % 3 = 2 THEN concat('K', a) END AS a_icao, CAST(NULL AS VARCHAR) AS a_iata,
        CASE WHEN k % 3 = 0 THEN concat('Given ', a) END AS a_name,
        CASE WHEN k % 3 = 1 THEN CAST(a % 5 AS VARCHAR) END AS a_cc
    FROM listed
), timed AS (
    SELECT *,
        CASE WHEN (k // 5) % 6 IN (0, 1, 2, 4) THEN happened END AS actual,
        CASE k % 5 WHEN 0 THEN strftime(sched, '%Y-%m-%d %H:%MZ') WHEN 1 THEN strftime(sched, '%Y-%m-%dT%H:%M:%SZ')
            WHEN 2 THEN strftime(sched + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S+05:30')
            WHEN 3 THEN strftime(sched, '%Y-%m-%d %H:%M:%SZ')
            ELSE strftime(sched - INTERVAL 3 HOUR, '%Y-%m-%d %H:%M-03:00') END AS sched_text,
        CASE (k // 5) % 6 WHEN 0 THEN strftime(happened, '%Y-%m-%d %H:%M:%SZ')
            WHEN 1 THEN strftime(happened, '%Y-%m-%dT%H:%M:%SZ')
            WHEN 2 THEN strftime(happened + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M:%S+05:30')
            WHEN 3 THEN 'n/a' WHEN 4 THEN strftime(happened, '%Y-%m-%d %H:%M:%SZ') END AS actual_text
    FROM told
)"""


def _sided(own_default: str = "NULL") -> str:
    """Origin and destination columns; ``own_default`` names a joined default row to fill from."""
    fill = (lambda value, name: f"coalesce({value}, {own_default}.{name})") if own_default != "NULL" else (
        lambda value, name: value)
    parts = {"icao": "icao", "iata": "iata", "name": "name", "country_code": "cc"}
    columns = []
    for name, short in parts.items():
        own = fill(f"CASE WHEN short THEN b_{short} ELSE a_{short} END", name)
        other = f"CASE WHEN NOT short THEN b_{short} END"
        columns.append(f"CASE movement_type WHEN 'Departure' THEN {own} ELSE {other} END AS origin_{name}")
        columns.append(f"CASE movement_type WHEN 'Arrival' THEN {own} ELSE {other} END AS destination_{name}")
    for side, own_type in [("departure", "Departure"), ("arrival", "Arrival")]:
        for kind, source in [("scheduled", "sched"), ("actual", "actual")]:
            given = f"movement_type = '{own_type}' OR NOT short"
            columns.append(f"CASE WHEN {given} THEN {source} END AS {kind}_{side}_utc")
            columns.append(f"CASE WHEN {given} THEN {source}_text END AS {kind}_{side}_text")
    return ", ".join(columns)


_CLEANED = """
cleaned AS (
    SELECT airport_iata, ingest_seq, doc_id, movement_type, movement_rank, pos, flight_number, status,
        aircraft_registration, aircraft_model, aircraft_manufacturer, airline_name, airline_code_iata,
        airline_code_icao, {sided}
    FROM timed {join}
)"""
_RAW = _CLEANED.format(sided=_sided(), join="")
_FILLED = _CLEANED.format(sided=_sided("dim"), join="LEFT JOIN {dim} dim ON dim.iata = airport_iata {where}")

_ETL = f"WITH {_SEEDS}, {_DOCS}, {_LISTED}, "
_FROM_RAW = _ETL + _RAW
_FROM_SEEDS = _ETL + _FILLED.format(dim="seeds", where="")
_FROM_ETL = _ETL + _FILLED.format(
    dim="extended", where="WHERE airport_iata IN (SELECT iata_code FROM docs WHERE missing = '')")
_FROM_AT = _ETL + _FILLED.format(
    dim="extended", where="""WHERE airport_iata IN (SELECT iata_code FROM docs WHERE missing = '')
        AND airport_iata IN ('LHR', 'SFO', 'C000030') AND ingest_seq BETWEEN 5 AND 20""")

# Many documents for each airport: each sync goes with the last one at or before it, or else with the first.
_HISTORY = f"""
hist AS (
    SELECT c_custkey * 7 % 27 AS ingest_seq, printf('%012d', c_custkey) AS doc_id, {_IATA.format('(c_custkey % 40)')} AS iata_code,
        printf('K%06d', c_custkey % 40) AS icao_code, c_name AS name, c_mktsegment AS city, c_nationkey,
        CASE WHEN c_custkey % 11 <> 5 THEN lower(c_mktsegment) END AS country_code,
        c_custkey % 11 <> 5 AND c_custkey % 7 <> 3 AS accepted
    FROM customer
), known AS (
    SELECT iata, icao, name, country_code FROM seeds
    UNION ALL SELECT iata_code, icao_code, name, coalesce(country_code, '') FROM hist WHERE iata_code NOT IN (SELECT iata FROM seeds)
    QUALIFY row_number() OVER (PARTITION BY iata_code ORDER BY ingest_seq, doc_id) = 1
), decided AS (
    SELECT s.airport_iata, s.ingest_seq, h.ingest_seq AS own_seq, h.doc_id AS own_doc, h.accepted
    FROM (SELECT DISTINCT airport_iata, ingest_seq FROM timed) s JOIN hist h ON h.iata_code = s.airport_iata
    QUALIFY row_number() OVER (PARTITION BY s.airport_iata, s.ingest_seq ORDER BY h.ingest_seq <= s.ingest_seq DESC,
        CASE WHEN h.ingest_seq <= s.ingest_seq THEN -h.ingest_seq ELSE h.ingest_seq END, h.doc_id DESC) = 1
), """
_FROM_HISTORY = _ETL + _HISTORY + _FILLED.format(
    dim="known", where="JOIN decided USING (airport_iata, ingest_seq) WHERE accepted")

_IDS = "airport_iata, ingest_seq, doc_id, movement_type, pos"
_FLIGHT_COLUMNS = """flight_number, aircraft_registration, origin_icao, origin_iata, origin_name, origin_country_code,
    destination_icao, destination_iata, destination_name, destination_country_code, scheduled_departure_utc,
    actual_departure_utc, scheduled_arrival_utc, actual_arrival_utc, status, movement_type, airline_code_iata,
    airline_code_icao"""
_AIRCRAFT_COLUMNS = """flight_number, aircraft_registration, aircraft_model, airline_code_icao, airline_code_iata,
    airline_name, aircraft_manufacturer"""
_RAW_COLUMNS = f"""{_IDS}, flight_number, status, origin_icao, origin_iata, origin_name, origin_country_code,
    destination_icao, destination_iata, destination_name, destination_country_code,
    scheduled_departure_text AS scheduled_departure_utc, actual_departure_text AS actual_departure_utc,
    scheduled_arrival_text AS scheduled_arrival_utc, actual_arrival_text AS actual_arrival_utc,
    aircraft_registration, aircraft_model, airline_name, airline_code_iata, airline_code_icao"""

_DELAYS = """, delays AS (
    SELECT airport_iata, ingest_seq, flight_number, status, origin_name, destination_name,
        scheduled_arrival_utc AS sched_time, actual_arrival_utc AS actual_time,
        CAST(scheduled_arrival_utc AS DATE) AS delay_date,
        coalesce(date_diff('microsecond', scheduled_arrival_utc, actual_arrival_utc), 0) AS us,
        us / 60000000 AS delay_min,
        coalesce(status = 'Delayed', false) OR us > 0 AS is_delayed,
        coalesce(lower(status) LIKE '%cancel%', false) AS is_canceled
    FROM cleaned WHERE movement_type = 'Arrival'
), unique_delays AS (
    SELECT DISTINCT ON (airport_iata, ingest_seq, origin_name, destination_name, sched_time) * FROM delays
    ORDER BY airport_iata, ingest_seq, origin_name, destination_name, sched_time, us DESC,
        flight_number NULLS FIRST, status NULLS FIRST
), summary AS (
    SELECT airport_iata, delay_date, CAST(count(DISTINCT sched_time) AS INTEGER) AS total_flights,
        CAST(count(*) FILTER (is_delayed) AS INTEGER) AS delayed_flights,
        CAST(coalesce(round_even((sum(us) FILTER (us > 0)) / (count(*) FILTER (us > 0)) / 60000000, 0), 0) AS INTEGER)
            AS avg_delay_min,
        CAST(coalesce(round_even((median(us) FILTER (us > 0)) / 60000000, 0), 0) AS INTEGER) AS median_delay_min,
        CAST(count(*) FILTER (is_canceled) AS INTEGER) AS canceled_flight
    FROM unique_delays WHERE delay_date IS NOT NULL GROUP BY airport_iata, ingest_seq, delay_date
)"""
_FIRST_AIRCRAFT = """SELECT {columns} FROM cleaned WHERE aircraft_registration IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY aircraft_registration
        ORDER BY {first} ingest_seq, movement_rank, doc_id, pos) = 1"""


def _etl() -> dict[str, str]:
    return {
        "t01_explode_feed": f"{_FROM_RAW} SELECT {_IDS}, movement_rank, flight_number AS number, status FROM cleaned",
        "t02_normalise_movement": f"""{_FROM_RAW} SELECT {_IDS}, origin_iata, destination_iata,
            scheduled_departure_text AS departure_text, scheduled_arrival_text AS arrival_text FROM cleaned""",
        "t03_fill_airport_defaults": f"""{_FROM_SEEDS} SELECT {_IDS}, origin_icao, origin_iata, origin_name,
            origin_country_code, destination_icao, destination_iata, destination_name, destination_country_code
            FROM cleaned""",
        "t04_extend_airport_defaults": f"{_FROM_RAW} SELECT * FROM extended",
        "t05_project_flights": f"{_FROM_RAW} SELECT {_RAW_COLUMNS} FROM cleaned",
        "t07_parse_utc": f"""{_FROM_RAW} SELECT {_IDS}, scheduled_departure_utc, actual_departure_utc,
            scheduled_arrival_utc, actual_arrival_utc FROM cleaned""",
        "t09_derive_manufacturer": f"{_FROM_RAW} SELECT {_IDS}, aircraft_model, aircraft_manufacturer FROM cleaned",
        "t10_build_flights": f"{_FROM_SEEDS} SELECT {_FLIGHT_COLUMNS} FROM cleaned",
        "t11_build_aircraft": f"{_FROM_SEEDS} {_FIRST_AIRCRAFT.format(columns=_AIRCRAFT_COLUMNS, first='')}",
        "t12_build_airport": f"{_FROM_RAW} SELECT * FROM docs",
        "t13_compute_delays": f"{_FROM_SEEDS} {_DELAYS} SELECT * EXCLUDE (us) FROM delays",
        "t14_dedupe_codeshares": f"{_FROM_SEEDS} {_DELAYS} SELECT * EXCLUDE (us) FROM unique_delays",
        "t15_delay_summary": f"{_FROM_SEEDS} {_DELAYS} SELECT * FROM summary",
        "t16_run_etl": f"{_FROM_ETL} {_DELAYS} SELECT * FROM summary",
        "t16_run_etl_airports": f"""{_FROM_ETL} SELECT icao_code, iata_code, name, city, country, continent, latitude,
            longitude, timezone FROM docs WHERE missing = '' AND iata_code IN (SELECT airport_iata FROM cleaned)""",
        "t16_run_etl_at": f"{_FROM_AT} SELECT {_FLIGHT_COLUMNS} FROM cleaned",
        "t16_sync_documents": f"{_FROM_HISTORY} SELECT * FROM decided",
        "t16_run_etl_resynced": f"{_FROM_HISTORY} SELECT {_FLIGHT_COLUMNS} FROM cleaned",
        "t16_run_etl_resynced_airports": f"""{_FROM_HISTORY} SELECT icao_code, iata_code, name, city,
            concat('Country ', c_nationkey) AS country, concat('Continent ', c_nationkey % 5) AS continent,
            c_nationkey * 2.5::DOUBLE - 30 AS latitude, c_nationkey * 6.25::DOUBLE - 70 AS longitude, 'UTC' AS timezone
            FROM hist WHERE (iata_code, ingest_seq, doc_id) IN (SELECT airport_iata, own_seq, own_doc FROM decided WHERE accepted)
            QUALIFY row_number() OVER (PARTITION BY iata_code ORDER BY ingest_seq DESC, doc_id DESC) = 1""",
        "t16_run_etl_skipped": f"""{_FROM_ETL} SELECT iata_code, concat('missing: ', replace(missing, ',', ', ')) AS reason
            FROM docs WHERE missing <> ''
            UNION ALL SELECT iata_code, 'no flight data' FROM docs
            WHERE missing = '' AND iata_code NOT IN (SELECT airport_iata FROM cleaned)""",
        "s01_read_flight_feed": f"{_FROM_RAW} SELECT {_RAW_COLUMNS} FROM cleaned",
        "s02_read_airport_feed": f"""{_FROM_RAW} SELECT ingest_seq, doc_id, iata_code AS iata, name AS full_name,
            upper(country_code) AS country_code, latitude AS lat, timezone AS time_zone FROM docs""",
        "s04_upsert_airports": _UPSERT,
        "t16_run_etl_replaced": f"{_FROM_ETL} SELECT {_FLIGHT_COLUMNS} FROM cleaned",
        # Every second document of a chain founds a row, and the one after it changes that row.
        "s04_upsert_airports_chains": """
            WITH d AS (SELECT *, (c_custkey - 1) // 200 AS chain, (c_custkey - 1) % 200 AS i FROM customer)
            SELECT concat('K', f.chain, '-', (f.i + 1) // 2) AS icao_code, concat('A', f.chain, '-', f.i // 2) AS iata_code,
                coalesce(u.c_name, f.c_name) AS name, coalesce(u.c_mktsegment, f.c_mktsegment) AS city,
                concat('Country ', coalesce(u.c_nationkey, f.c_nationkey)) AS country, 'None' AS continent,
                coalesce(u.c_nationkey, f.c_nationkey)::DOUBLE AS latitude, coalesce(u.c_nationkey, f.c_nationkey)::DOUBLE AS longitude,
                'UTC' AS timezone
            FROM d f LEFT JOIN d u ON u.chain = f.chain AND u.i = f.i + 1 WHERE f.i % 2 = 0""",
        "s05_append_flights": f"""{_FROM_RAW} SELECT {_FLIGHT_COLUMNS} FROM cleaned
            UNION ALL SELECT {_FLIGHT_COLUMNS} FROM cleaned""",
        "s05_append_flights_deduped": f"""{_FROM_RAW} SELECT {_FLIGHT_COLUMNS} FROM cleaned
            QUALIFY row_number() OVER (PARTITION BY flight_number, scheduled_departure_utc
                ORDER BY ingest_seq, movement_rank, doc_id, pos) = 1""",
        "s06_insert_new_aircraft": f"""{_FROM_SEEDS}
            {_FIRST_AIRCRAFT.format(columns=_AIRCRAFT_COLUMNS, first='ingest_seq < 14,')}""",
        "s06_insert_new_aircraft_long": """SELECT * FROM (
            SELECT concat('FL', l_suppkey) AS flight_number, concat(repeat('R', 20), l_partkey) AS aircraft_registration,
                concat(repeat('Model ', 30), l_partkey % 50) AS aircraft_model, concat('AL', l_suppkey % 20) AS airline_code_icao,
                concat('A', l_suppkey % 20) AS airline_code_iata, concat('Airline ', l_suppkey % 30) AS airline_name,
                'Model' AS aircraft_manufacturer
            FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey
                ORDER BY l_orderkey % 2, l_orderkey, printf('%012d', l_suppkey), l_linenumber) = 1)""",
        "s07_append_delays": f"{_FROM_SEEDS} {_DELAYS} SELECT * FROM summary UNION ALL SELECT * FROM summary",
    }


# Suppliers 5m and 5m+1 update customer 3m where it has an IATA or an ICAO code and are new airports where
# it has not; 10m+2 and 10m+7 are one new airport; 5m+3 has no code; 5m+4 has an IATA code of its own.
_UPSERT = """
WITH stored AS (
    SELECT c_custkey AS c, CASE WHEN c_custkey % 10 <> 8 THEN concat('K', c_custkey) END AS icao_code,
        CASE WHEN c_custkey % 10 <> 7 THEN concat('X', c_custkey) END AS iata_code, c_name AS name,
        c_mktsegment AS city, concat('Country ', c_nationkey) AS country, 'Old' AS continent,
        c_nationkey::DOUBLE AS latitude, c_nationkey::DOUBLE AS longitude, 'UTC' AS timezone
    FROM customer
), incoming AS (
    SELECT s_suppkey AS s, s_suppkey % 5 AS kind, s_suppkey // 5 * 3 AS c, s_suppkey % 3 AS ingest_seq, s_name AS name,
        CASE WHEN s_suppkey % 3 <> 0 THEN concat('City ', s_suppkey) END AS city,
        concat('Country ', s_nationkey) AS country, 'New' AS continent, s_nationkey::DOUBLE AS latitude,
        s_nationkey::DOUBLE AS longitude, CASE WHEN s_suppkey % 7 <> 0 THEN 'UTC+1' END AS timezone
    FROM supplier
), settled AS (
    SELECT *,
        (kind = 0 AND c % 10 <> 7 OR kind = 1 AND c % 10 <> 8) AND c IN (SELECT c FROM stored) AS updates,
        CASE kind WHEN 0 THEN concat('Z', s) WHEN 1 THEN concat('K', c) WHEN 2 THEN concat('W', s // 10) END AS icao_code,
        CASE kind WHEN 0 THEN concat('X', c) WHEN 2 THEN concat('Y', s // 10) WHEN 4 THEN concat('V', s) END AS iata_code
    FROM incoming
), changes AS (
    SELECT * FROM settled WHERE updates QUALIFY row_number() OVER (PARTITION BY c ORDER BY ingest_seq DESC, s DESC) = 1
)
SELECT st.icao_code, st.iata_code, coalesce(ch.name, st.name) AS name,
    CASE WHEN ch.s IS NULL THEN st.city ELSE ch.city END AS city, coalesce(ch.country, st.country) AS country,
    coalesce(ch.continent, st.continent) AS continent, coalesce(ch.latitude, st.latitude) AS latitude,
    coalesce(ch.longitude, st.longitude) AS longitude,
    CASE WHEN ch.s IS NULL THEN st.timezone ELSE ch.timezone END AS timezone
FROM stored st LEFT JOIN changes ch ON ch.c = st.c
UNION ALL
SELECT icao_code, iata_code, name, city, country, continent, latitude, longitude, timezone FROM settled
WHERE NOT updates
QUALIFY row_number() OVER (
    PARTITION BY CASE WHEN kind = 2 THEN concat('Y', s // 10) ELSE concat('own ', s) END ORDER BY ingest_seq DESC, s DESC) = 1
"""


def sql() -> dict[str, str]:
    reports = {name: f"{_BASE} {text}" for name, text in _reports().items()}
    return {name.strip(): text for name, text in sorted({**reports, **_etl()}.items())}
