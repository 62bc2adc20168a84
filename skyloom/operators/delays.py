"""Arrival delays per flight and per airport and day."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions.times import micros_between
from skyloom.operators.dedupe import first_per_key
from skyloom.schemas import AIRPORT_DELAYS, SYNC_KEYS

_MICROS_PER_MINUTE = 60_000_000


def compute_delays(df: DataFrame) -> DataFrame:
    """Arrivals with their delay; ``sched_time`` and ``actual_time`` are the arrival times.

    ``delay_us`` is the exact delay in microseconds, early negative and unknown 0; ``delay_min`` the
    same in minutes. A flight is delayed by status or by a positive delay, and cancelled when its
    status mentions it in any case.
    """
    timed = (
        df.filter(F.col("movement_type") == "Arrival")
        .withColumn("sched_time", F.col("scheduled_arrival_utc"))
        .withColumn("actual_time", F.col("actual_arrival_utc"))
    )
    late = micros_between(F.col("sched_time"), F.col("actual_time"))
    return timed.withColumns({
        "delay_date": F.to_date("sched_time"),
        "delay_us": F.coalesce(late, F.lit(0)),
    }).withColumns({
        "delay_min": F.col("delay_us") / _MICROS_PER_MINUTE,
        "is_delayed": F.coalesce(F.col("status") == "Delayed", F.lit(False)) | (F.col("delay_us") > 0),
        "is_canceled": F.coalesce(F.lower("status").contains("cancel"), F.lit(False)),
    })


def dedupe_codeshares(delays: DataFrame) -> DataFrame:
    """One row per sync, route and scheduled time: the one with the largest delay."""
    order = [F.col("delay_us").desc(), F.col("flight_number").asc_nulls_first(), F.col("status").asc_nulls_first()]
    return first_per_key(delays, ["sched_time", *SYNC_KEYS, "origin_name", "destination_name"], order)


def daily_delays(cleaned: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """``compute_delays``, ``dedupe_codeshares`` and ``delay_summary`` in two shuffles; ``more`` as in ``delay_summary``.

    Rows without a scheduled time belong to no day and go first. One dealing by sync and scheduled time then serves
    the dedupe, the counts and the distinct times, and splits a busy airport; the second shuffle carries counts
    to the day.
    """
    delays = compute_delays(cleaned).filter(F.col("sched_time").isNotNull())
    return delay_summary(dedupe_codeshares(delays.repartition("sched_time", *SYNC_KEYS)), more)


def delay_summary(flights: DataFrame, more: Iterable[str] = ()) -> DataFrame:
    """The ``airport_delays`` rows of each sync, and the sync columns ``more``; rows without a scheduled time belong to no day.

    Mean and median look at positive delays only. Delays are first counted per distinct time and
    value, so the shuffle to (airport, day) carries counts, and the median's state is bounded by the
    number of distinct delays of a day and not by its flights.
    """
    day = [*SYNC_KEYS, "delay_date"]
    counted = (
        flights.filter(F.col("delay_date").isNotNull())
        .groupBy(*day, "sched_time", "delay_us")
        .agg(
            F.count("*").alias("n"),
            F.sum(F.col("is_delayed").cast("bigint")).alias("n_delayed"),
            F.sum(F.col("is_canceled").cast("bigint")).alias("n_canceled"),
        )
    )
    n_late = F.when(F.col("delay_us") > 0, F.col("n"))
    mean = F.sum(F.col("delay_us") * n_late) / F.sum(n_late)
    middle = F.percentile(F.when(F.col("delay_us") > 0, F.col("delay_us")), 0.5, F.col("n"))

    def minutes(micros):
        return F.coalesce(F.bround(micros / _MICROS_PER_MINUTE, 0), F.lit(0))

    per_day = counted.groupBy(*day).agg(
        F.count_distinct("sched_time").alias("total_flights"),
        F.sum("n_delayed").alias("delayed_flights"),
        minutes(mean).alias("avg_delay_min"),
        minutes(middle).alias("median_delay_min"),
        F.sum("n_canceled").alias("canceled_flight"),
    )
    return per_day.select(*[F.col(f.name).cast(f.dataType) for f in AIRPORT_DELAYS],
                          *[c for c in more if c not in AIRPORT_DELAYS.names])
