"""Time expressions on naive UTC timestamps.

None of them depends on the session time zone: values are moved through epoch microseconds and
day-time intervals instead of casts between the two timestamp types.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Fixed value: the accepted form, from the first to the last character.
FORM = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)? *(Z|[+-][0-9]{2}:?[0-9]{2})?\z"


def time_text(text: Column) -> Column:
    """The whole of ``text`` if it has the accepted form, else empty text."""
    return F.regexp_extract(text, FORM, 0)


def utc_timestamp(text: Column) -> Column:
    """Parse ISO-like text to naive UTC; text that is no time, or NULL, gives NULL.

    The form is ``yyyy-MM-dd``, then a blank or ``T`` and ``HH:mm[:ss[.ffffff]]``, then ``Z`` or an
    offset; text without a zone is taken as UTC, and anything else in the whole text makes it no time (a plain date or
    hour, or a small ``z``, too).
    """
    return accepted_timestamp(time_text(text))


def accepted_timestamp(text: Column) -> Column:
    """The time in the outcome of ``time_text``. Seconds and zone are put in where they are missing and the rest is left
    to the built-in cast, which compiles to little code."""
    seconds = F.when(F.substring(text, 17, 1) == ":", F.lit("")).otherwise(F.lit(":00"))
    zone = F.when(F.right(text, F.lit(6)).rlike("[Z+-]"), F.lit("")).otherwise(F.lit("Z"))
    rest = F.replace(text.substr(F.lit(17), F.length(text)), F.lit(" "))
    full = F.concat(F.substring(text, 1, 16), seconds, rest, zone)
    microsecond = F.expr("INTERVAL '0.000001' SECOND")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + microsecond * F.unix_micros(full.try_cast("timestamp"))


def micros_between(start: Column, end: Column) -> Column:
    """Whole microseconds from ``start`` to ``end``; negative when ``end`` is earlier."""
    seconds = (end - start).cast("interval second").cast("decimal(18,6)").cast("double")
    return F.round(seconds * 1000000).cast("bigint")


def whole_seconds(moment: Column) -> Column:
    """``moment`` with its fraction of a second cut off."""
    start = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    elapsed = (moment - start).cast("interval second").cast("bigint")
    return start + F.expr("INTERVAL '1' SECOND") * elapsed
