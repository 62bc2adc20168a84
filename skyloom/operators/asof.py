"""As-of join: for each moment of a key, the state of that key that was the last one at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import materialise


def as_of(
    moments: DataFrame, states: DataFrame, key: str, at: str, order: Sequence[str], values: Sequence[str],
    or_first: bool = False, ranges: int | None = None,
) -> DataFrame:
    """``key, at`` of the distinct ``moments`` with ``state``, a struct of the state's ``values``.

    ``state`` is NULL where the key has no state at or before the moment; with ``or_first`` it is then the key's first one.
    Of states at one time the last under ``order`` counts. A NULL time lies before all others; rows without a key are left out.

    Time is cut into ``ranges`` (a few times the shuffle partitions), and a key's rows are dealt out by range, so a key
    that holds most rows is sorted in many tasks. Each range then takes over the last state before it, from a table of one
    row per key and range.
    """
    spark = moments.sparkSession
    ranges = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = moments.filter(F.col(key).isNotNull()).select(key, at).distinct().withColumns(
        {"state": F.lit(None).cast(states.select(F.struct(*values)).schema[0].dataType), "asked": F.lit(1)})
    known = states.filter(F.col(key).isNotNull()).groupBy(key, at).agg(
        F.max_by(F.struct(*values), F.struct(*order)).alias("state")).withColumn("asked", F.lit(0))
    events = materialise(asked.unionByName(known))
    low, high = events.agg(F.min(at), F.max(at)).first()
    width = max(1, -(-((high or 0) - (low or 0) + 1) // ranges))
    bucket = F.coalesce(F.floor((F.col(at) - F.lit(low or 0)) / F.lit(width)).cast("long"), F.lit(-1))
    events = events.withColumn("range", bucket)

    within = Window.partitionBy(key, "range").orderBy(F.col(at).asc_nulls_first(), "asked")
    found = events.withColumn("own", F.last("state", ignorenulls=True).over(
        within.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter("asked = 1")
    # One row per key and range: at most ``ranges`` and one for each key.
    ends = events.groupBy(key, "range").agg(
        F.max_by("state", F.when(F.col("asked") == 0, F.struct(at))).alias("last"),
        F.min_by("state", F.when(F.col("asked") == 0, F.struct(at))).alias("first"))
    earlier = Window.partitionBy(key).orderBy("range")
    whole = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        key, "range",
        F.last("last", ignorenulls=True).over(earlier.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(whole).alias("first"))
    choices = ["own", "before", "first"] if or_first else ["own", "before"]
    return found.join(ends, [key, "range"]).select(key, at, F.coalesce(*choices).alias("state"))
