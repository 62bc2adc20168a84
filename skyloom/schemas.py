"""Table and feed schemas.

Text widths are kept as field metadata (``width``) and applied by the sinks, since Spark strings have
no length. Surrogate ids are not stored: no report reads one, and a dense counter would need a global
order. Where the order of arrival matters it is carried by ``ORDER_COLUMNS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _text(name: str, width: int) -> T.StructField:
    return T.StructField(name, T.StringType(), True, {"width": width})


# Column names, widths and order of the four stored tables.
AIRPORT = T.StructType([
    _text("icao_code", 10),
    _text("iata_code", 10),
    _text("name", 255),
    _text("city", 100),
    _text("country", 100),
    _text("continent", 100),
    T.StructField("latitude", T.DecimalType(10, 8)),
    T.StructField("longitude", T.DecimalType(11, 8)),
    _text("timezone", 100),
])

FLIGHTS = T.StructType([
    _text("flight_number", 20),
    _text("aircraft_registration", 20),
    _text("origin_icao", 10),
    _text("origin_iata", 10),
    _text("origin_name", 255),
    _text("origin_country_code", 10),
    _text("destination_icao", 10),
    _text("destination_iata", 10),
    _text("destination_name", 255),
    _text("destination_country_code", 10),
    T.StructField("scheduled_departure_utc", T.TimestampNTZType()),
    T.StructField("actual_departure_utc", T.TimestampNTZType()),
    T.StructField("scheduled_arrival_utc", T.TimestampNTZType()),
    T.StructField("actual_arrival_utc", T.TimestampNTZType()),
    _text("status", 50),
    _text("movement_type", 255),
    _text("airline_code_iata", 10),
    _text("airline_code_icao", 10),
])

AIRCRAFT = T.StructType([
    _text("flight_number", 20),
    _text("aircraft_registration", 20),
    _text("aircraft_model", 100),
    _text("airline_code_icao", 10),
    _text("airline_code_iata", 10),
    _text("airline_name", 255),
    _text("aircraft_manufacturer", 50),
])

AIRPORT_DELAYS = T.StructType([
    _text("airport_iata", 10),
    T.StructField("delay_date", T.DateType()),
    T.StructField("total_flights", T.IntegerType()),
    T.StructField("delayed_flights", T.IntegerType()),
    T.StructField("avg_delay_min", T.IntegerType()),
    T.StructField("median_delay_min", T.IntegerType()),
    T.StructField("canceled_flight", T.IntegerType()),
])

TABLES = {
    "airport": AIRPORT,
    "flights": FLIGHTS,
    "aircraft": AIRCRAFT,
    "airport_delays": AIRPORT_DELAYS,
}

TIME_COLUMNS = [f.name for f in FLIGHTS if isinstance(f.dataType, T.TimestampNTZType)]

# A sync is the set of documents that share SYNC_KEYS; ORDER_COLUMNS is the order in which its flights
# arrive: arrivals before departures, then document, then position in the list.
SYNC_KEYS = ["airport_iata", "ingest_seq"]
ORDER_COLUMNS = ["ingest_seq", "movement_rank", "doc_id", "pos"]


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


LEG = T.StructType([
    T.StructField("airport", _texts("icao", "iata", "name", "countryCode")),
    T.StructField("scheduledTime", _texts("utc")),
    T.StructField("revisedTime", _texts("utc")),
])
MOVEMENT = T.StructType([
    T.StructField("number", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("departure", LEG),
    T.StructField("arrival", LEG),
    T.StructField("movement", LEG),
    T.StructField("aircraft", _texts("reg", "model")),
    T.StructField("airline", _texts("name", "iata", "icao")),
])
FEED = T.StructType([
    T.StructField("arrivals", T.ArrayType(MOVEMENT)),
    T.StructField("departures", T.ArrayType(MOVEMENT)),
])

# Where each stored or derived flight column sits in a feed record.
FEED_PATHS = {
    "flight_number": "number",
    "status": "status",
    "movement_type": "movement_type",
    "origin_icao": "departure.airport.icao",
    "origin_iata": "departure.airport.iata",
    "origin_name": "departure.airport.name",
    "origin_country_code": "departure.airport.countryCode",
    "scheduled_departure_utc": "departure.scheduledTime.utc",
    "actual_departure_utc": "departure.revisedTime.utc",
    "destination_icao": "arrival.airport.icao",
    "destination_iata": "arrival.airport.iata",
    "destination_name": "arrival.airport.name",
    "destination_country_code": "arrival.airport.countryCode",
    "scheduled_arrival_utc": "arrival.scheduledTime.utc",
    "actual_arrival_utc": "arrival.revisedTime.utc",
    "aircraft_registration": "aircraft.reg",
    "aircraft_model": "aircraft.model",
    "airline_name": "airline.name",
    "airline_code_iata": "airline.iata",
    "airline_code_icao": "airline.icao",
}

# Where each airport column sits in an airport document.
AIRPORT_PATHS = {
    "icao_code": "icao",
    "iata_code": "iata",
    "name": "fullName",
    "city": "municipalityName",
    "country": "country.name",
    "continent": "continent.name",
    "latitude": "location.lat",
    "longitude": "location.lon",
    "timezone": "timeZone",
}

# IATA, ICAO, name and country code used when a feed leaves out its own airport.
AIRPORT_DEFAULTS = [
    ("DEL", "VIDP", "New Delhi Indira Gandhi", "in"),
    ("BLR", "VOBL", "Banglaore Bengaluru", "in"),
    ("DXB", "OMDB", "Dubai", "ae"),
    ("HKG", "VHHH", "Hong Kong Chek Lap Kok", "hk"),
    ("HND", "RJTT", "Tokyo Haneda", "jp"),
    ("SYD", "YSSY", "Sydney Kingsford Smith", "au"),
    ("SFO", "KSFO", "San Francisco", "us"),
    ("JFK", "KJFK", "New York John F Kennedy", "us"),
    ("CGH", "SBSP", "São Paulo Congonhas", "br"),
    ("LHR", "EGLL", "London Heathrow", "gb"),
    ("CDG", "LFPG", "Paris Charles de Gaulle", "fr"),
    ("JNB", "FAOR", "Jo'anna Johannesburg OR Tambo", "za"),
    ("SIN", "WSSS", "Singapore", "sg"),
]


def conform(df: DataFrame, schema: T.StructType, cut_text: bool = False) -> DataFrame:
    """``df`` with exactly the columns, types and, with ``cut_text``, text widths of ``schema``."""

    def stored(field: T.StructField) -> Column:
        value = F.col(field.name).cast(field.dataType)
        if cut_text and "width" in field.metadata:
            value = F.substring(value, 1, field.metadata["width"])
        return value.alias(field.name)

    return df.select(*[stored(f) for f in schema])
