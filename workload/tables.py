"""Flight data derived from the driver's tables, as plain projections.

* ``flights`` is ``lineitem``: an order is one physical flight, its lines are the codeshare listings.
* ``aircraft`` is ``part``; ``airport`` is ``nation`` with ``region``, and every ``customer`` as an airport
  that no flight serves.
* Airport documents are ``customer``; flight documents are ``orders``, each with up to two arrivals and
  two departures, at the first 40 of those airports. A sync is the two days at the start of a quarter.

Origins are the 25 nations. Destinations lie 1 to 15 steps ahead on a ring of 28 airports, so only
routes of 13 to 15 steps have a way back and three destinations are not stored. NULLs, unknown
statuses, codeshares, early flights and mixed time formats are spread by rules on other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.schemas import AIRCRAFT, AIRPORT, FLIGHTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flights(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "lineitem").selectExpr(
        "*",
        "l_orderkey % 25 AS o",
        "1 + (l_orderkey div 25) % 15 AS step",
    ).selectExpr(
        "*",
        "(o + step) % 28 AS d",
        "timestamp_ntz'2025-01-01 00:00:00' + make_dt_interval(0, 0, int(l_orderkey * 7919 % 525600)) AS departs",
        "make_dt_interval(0, 0, int(l_quantity) - 25) AS shift",
    ).selectExpr(
        "*",
        "CASE WHEN NOT (l_linenumber = 7 AND l_quantity < 5) "
        "THEN departs + make_dt_interval(0, int(2 + step)) END AS arrives",
    )
    return keyed.selectExpr(
        "CASE WHEN NOT (l_linenumber = 1 AND l_quantity = 50) "
        "THEN 'FL' || l_suppkey || '-' || l_partkey % 50 END AS flight_number",
        "CASE WHEN l_discount <> 0 THEN 'REG' || l_partkey END AS aircraft_registration",
        "'I' || lpad(o, 3, '0') AS origin_icao",
        "'N' || lpad(o, 2, '0') AS origin_iata",
        "'NATION_' || o AS origin_name",
        "string(o % 5) AS origin_country_code",
        "'I' || lpad(d, 3, '0') AS destination_icao",
        "CASE WHEN NOT (l_discount > 0.095 AND l_tax > 0.075) THEN 'N' || lpad(d, 2, '0') END AS destination_iata",
        "CASE WHEN d <> 27 THEN 'NATION_' || d END AS destination_name",
        "CASE WHEN d <> 26 THEN string(d % 5) END AS destination_country_code",
        "departs AS scheduled_departure_utc",
        "CASE WHEN l_tax <> 0 THEN departs + shift END AS actual_departure_utc",
        "arrives AS scheduled_arrival_utc",
        "CASE WHEN l_tax <> 0 AND l_returnflag <> 'R' THEN arrives + shift END AS actual_arrival_utc",
        "CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 'CanceledUncertain' WHEN l_returnflag = 'R' "
        "THEN 'Canceled' WHEN l_returnflag = 'A' THEN 'Delayed' ELSE 'Arrived' END AS status",
        "CASE WHEN l_linestatus = 'F' THEN 'Arrival' ELSE 'Departure' END AS movement_type",
        "'A' || l_suppkey % 20 AS airline_code_iata",
        "'AL' || l_suppkey % 20 AS airline_code_icao",
    ).select(*FLIGHTS.names)


def aircraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(
        "'FL' || p_partkey div 20 || '-' || p_partkey % 50 AS flight_number",
        "'REG' || p_partkey AS aircraft_registration",
        "CASE WHEN p_size <> 2 THEN p_name || ' ' || p_type END AS aircraft_model",
        "'AL' || p_partkey % 20 AS airline_code_icao",
        "'A' || p_partkey % 20 AS airline_code_iata",
        "CASE WHEN p_size <> 1 THEN 'Airline ' || p_partkey % 30 END AS airline_name",
        "CASE WHEN p_size <> 2 THEN split(p_name, ' ')[0] END AS aircraft_manufacturer",
    ).select(*AIRCRAFT.names)


def airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    served = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "'I' || lpad(n_nationkey, 3, '0') AS icao_code",
        "'N' || lpad(n_nationkey, 2, '0') AS iata_code",
        "n_name AS name",
        "n_name AS city",
        "r_name AS country",
        "r_name AS continent",
        "CAST(n_nationkey * 5 - 60 AS DECIMAL(10, 8)) AS latitude",
        "CAST(n_nationkey * 13 - 150 AS DECIMAL(11, 8)) AS longitude",
        "'UTC' AS timezone",
    )
    unserved = table(spark, sf_dir, "customer").selectExpr(
        "'K' || lpad(c_custkey, 9, '0') AS icao_code",
        "'X' || c_custkey AS iata_code",
        "c_name AS name",
        "c_mktsegment AS city",
        "'NATION_' || c_nationkey AS country",
        "'None' AS continent",
        "CAST(c_nationkey * 2 - 20 AS DECIMAL(10, 8)) AS latitude",
        "CAST(c_nationkey * 7 - 80 AS DECIMAL(11, 8)) AS longitude",
        "'UTC' AS timezone",
    )
    return served.unionByName(unserved).select(*AIRPORT.names)


# Airports 0 to 12 of the feed carry real codes, so that the built-in defaults apply to them.
FEED_IATA = (
    "CASE WHEN {0} < 13 THEN element_at(array('DEL', 'BLR', 'DXB', 'HKG', 'HND', 'SYD', 'SFO', 'JFK', 'CGH', 'LHR', "
    "'CDG', 'JNB', 'SIN'), int({0} + 1)) ELSE 'C' || lpad({0}, 6, '0') END"
)


def _city(b: int) -> str:
    """The airport at the other end of a flight, as a constant."""
    name = f"'City {b}'" if b != 27 else "NULL"
    return f"named_struct('icao', 'K{b}', 'iata', 'N{b:02d}', 'name', {name}, 'countryCode', '{b % 5}')"


def _partial(a: int, k3: int) -> str:
    """What a document says of its own airport, as a constant: only a name, only a country or only an ICAO code."""
    given = [f"'Given {a}'", f"'{a % 5}'", f"'K{a}'"]
    name, country, icao = [text if i == k3 else "string(NULL)" for i, text in enumerate(given)]
    return f"named_struct('icao', {icao}, 'iata', string(NULL), 'name', {name}, 'countryCode', {country})"


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k",
        "o_custkey AS c",
        "o_custkey % 40 AS a",
        "(o_custkey % 40 + 1 + o_orderkey % 5) % 28 AS b",
        "bigint(datediff(o_orderdate, date'1995-01-01') div 90) AS ingest_seq",
        "o_orderkey % 3 AS k3",
        "o_orderkey % 4 = 0 AS short",
        "o_orderkey % 5 AS sched_form",
        "o_orderkey div 5 % 6 AS actual_form",
        "o_orderkey % 9 AS k9",
    ).selectExpr(
        "*",
        "IF(actual_form = 1, 'T', ' ') AS actual_gap",
        "IF(actual_form = 2, '+05:30', 'Z') AS actual_zone",
        "IF(actual_form = 2, 330, 0) AS actual_ahead",
        "IF(sched_form = 2, 330, IF(sched_form = 4, -180, 0)) AS sched_ahead",
    ).withColumn("sched", F.expr(
        "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(ingest_seq * 90), 0, int(k % 2880))"
    ))
    # Text forms by rule: with and without seconds, a blank or a T, Z or an offset, no time, nothing.
    told = keyed.withColumns({
        f"actual_{i}": F.expr(
            f"sched + make_dt_interval(0, 0, int((k * 7 + {i} * 13) % 90 - 30) + actual_ahead, k % 60)")
        for i in [1, 2]
    }).withColumns({
        "local_sched": F.expr("string(sched + make_dt_interval(0, 0, sched_ahead))"),
    }).withColumns({
        "sched_text": F.expr("""replace(substr(local_sched, 1, IF(sched_form IN (0, 4), 16, 19)), ' ', IF(sched_form = 1, 'T', ' '))
            || CASE sched_form WHEN 2 THEN '+05:30' WHEN 4 THEN '-03:00' ELSE 'Z' END""")
    } | {
        f"actual_text_{i}": F.expr(f"""CASE WHEN actual_form = 3 THEN 'n/a'
            WHEN actual_form <> 5 THEN replace(string(actual_{i}), ' ', actual_gap) || actual_zone END""")
        for i in [1, 2]
    }).withColumns({
        "other": F.expr(f"element_at(array({', '.join(map(_city, range(28)))}), int(b + 1))"),
        "own": F.expr(
            f"element_at(array({', '.join(_partial(a, k3) for k3 in range(3) for a in range(40))}), int(k3 * 40 + a + 1))"),
        "status": F.expr("""element_at(array('Canceled', 'CanceledUncertain', 'Delayed', NULL, 'Arrived', 'Arrived',
            'Arrived'), int(k % 7 + 1))"""),
        "model": F.expr("""CASE WHEN k9 = 1 THEN '' WHEN k9 <> 0 THEN IF(k9 = 2, '  Maker', 'Maker') || k % 4
            || IF(k9 = 2, '   M', ' M') || k % 50 END"""),
        "airline": F.expr("named_struct('name', 'Airline ' || c % 30, 'iata', 'A' || c % 20, 'icao', 'AL' || c % 20)"),
    })

    # Legs and their two listings are columns of their own. The lists are cut with a function of a function, whose projection Spark
    # compiles to many small methods; fused into one, it would pass the 8000 bytes up to which the JVM compiles a method.
    legs = told.withColumns({
        f"{side}_{i}": F.expr(f"named_struct('airport', {side}, 'scheduledTime', named_struct('utc', sched_text), "
                              f"'revisedTime', named_struct('utc', actual_text_{i}))")
        for side in ["own", "other"] for i in [1, 2]
    }).withColumns({
        f"movement_{i}": F.expr(f"IF(short, other_{i}, NULL)") for i in [1, 2]
    } | {
        f"{side}_{i}": F.expr(f"IF(short, NULL, {side}_{i})") for side in ["own", "other"] for i in [1, 2]
    } | {
        f"number_{i}": F.expr(f"CASE WHEN k % 41 <> 0 THEN 'FL' || k % 500 || '-{i}' END") for i in [1, 2]
    } | {
        f"aircraft_{i}": F.expr(
            f"named_struct('reg', CASE WHEN k % 13 <> 0 THEN 'R' || (c * 3 + {i}) END, 'model', model)")
        for i in [1, 2]
    })

    def listed(count: str, departure: str, arrival: str) -> Column:
        flights = ", ".join(
            f"named_struct('number', number_{i}, 'status', status, 'departure', {departure}_{i}, "
            f"'arrival', {arrival}_{i}, 'movement', movement_{i}, 'aircraft', aircraft_{i}, 'airline', airline)"
            for i in [1, 2]
        )
        return F.expr(f"CASE WHEN {count} IS NOT NULL THEN filter(array({flights}), (flight, i) -> i < {count}) END")

    return legs.select(
        F.expr(f"element_at(array({', '.join(FEED_IATA.format(a) for a in range(40))}), int(a + 1))").alias("airport_iata"),
        "ingest_seq",
        F.expr("lpad(k, 12, '0')").alias("doc_id"),
        listed("k3", departure="other", arrival="own").alias("arrivals"),
        listed("(k div 3) % 3", departure="own", arrival="other").alias("departures"),
    )


def airport_json(spark: SparkSession, sf_dir: str, airport: str = "c_custkey", sync: str = "c_custkey % 4") -> DataFrame:
    """Airport documents as JSON text: one per customer, some without a time zone or a country.

    ``airport`` and ``sync`` say whose document it is and at which sync.
    """
    return table(spark, sf_dir, "customer").selectExpr(
        f"bigint({sync}) AS ingest_seq",
        "lpad(c_custkey, 12, '0') AS doc_id",
        f"""to_json(struct(
            bigint({sync}) AS ingest_seq,
            lpad(c_custkey, 12, '0') AS doc_id,
            'K' || lpad({airport}, 6, '0') AS icao,
            {FEED_IATA.format(f"({airport})")} AS iata,
            c_name AS fullName,
            c_mktsegment AS municipalityName,
            CASE WHEN c_custkey % 11 <> 5 THEN named_struct('code', upper(c_mktsegment),
                'name', 'Country ' || c_nationkey) END AS country,
            named_struct('name', 'Continent ' || c_nationkey % 5) AS continent,
            named_struct('lat', c_nationkey * 2.5 - 30, 'lon', c_nationkey * 6.25 - 70) AS location,
            CASE WHEN c_custkey % 7 <> 3 THEN 'UTC' END AS timeZone)) AS json""",
    )


def airport_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return airport_json(spark, sf_dir).selectExpr("ingest_seq", "doc_id", "parse_json(json) AS doc")


def airport_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airport documents as JSON text, many for each of the feed's 40 airports, at one sync or another."""
    return airport_json(spark, sf_dir, "c_custkey % 40", "c_custkey * 7 % 27")
