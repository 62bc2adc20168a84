"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_word(text: Column) -> Column:
    """The first run of non-blank characters; NULL for NULL and for blank text."""
    return F.nullif(F.regexp_extract(text, r"(?U)(\S+)", 1), F.lit(""))


def percent_label(value: Column) -> Column:
    """``value`` rounded half-even to one decimal, followed by a percent sign."""
    return F.when(value.isNotNull(), F.format_string("%.1f%%", F.bround(value, 1)))


def named_code(name: Column, code: Column) -> Column:
    """``name (code)``, writing ``None`` for a missing part."""
    missing = F.lit("None")
    return F.concat(F.coalesce(name, missing), F.lit(" ("), F.coalesce(code, missing), F.lit(")"))
