"""Which loads of ``flights`` and ``airport_delays`` count.

Every append is a load: it writes to folders of its own (``load=<id>``), and its rows exist for readers once the ledger lists it.
So a load that breaks off half way leaves nothing behind that a reader sees, and may simply be run again. The ledger also lists
syncs whose rows in an older load were replaced by a newer one. It is a small table that is replaced by commits
(``sources.versions``): one row per load and per replaced sync, until ``compact`` has merged the loads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.sources import versions

#: ``gone`` rows are syncs of a load that no longer count; the other rows are the loads.
LEDGER = T.StructType([
    T.StructField("load", T.StringType()), T.StructField("gone", T.BooleanType()),
    T.StructField("airport_iata", T.StringType()), T.StructField("ingest_seq", T.LongType()),
])
#: One row per sync of a load, in folders by load.
SYNCS = T.StructType([
    T.StructField("airport_iata", T.StringType()), T.StructField("ingest_seq", T.LongType()), T.StructField("load", T.StringType())])


def new_load() -> str:
    return uuid.uuid4().hex


def rows(spark: SparkSession, root: str) -> DataFrame:
    return versions.read(spark, f"{root}/loads", LEDGER)


def live(spark: SparkSession, root: str) -> tuple[list[str], DataFrame | None]:
    """The loads that count, and ``load, airport_iata, ingest_seq`` of their replaced syncs, if there are any."""
    return live_of(rows(spark, root))


def live_of(ledger: DataFrame) -> tuple[list[str], DataFrame | None]:
    loads = ledger.groupBy("load").agg(F.max((~F.col("gone")).cast("int")).alias("live"), F.max(F.col("gone").cast("int")).alias("gone")).collect()
    gone = ledger.filter("gone").drop("gone") if any(r["gone"] for r in loads) else None
    return sorted(r["load"] for r in loads if r["live"]), gone


def counted(stored: DataFrame, loads: list[str], gone: DataFrame | None, airport_col: str) -> DataFrame:
    """The rows of ``stored`` (with ``load``, ``airport_col`` and ``ingest_seq``) that count. Other loads' folders are not opened."""
    kept = stored.filter(F.col("load").isin(loads))
    if gone is None:
        return kept
    names = {"load": "gone_load", "airport_iata": "gone_airport", "ingest_seq": "gone_seq"}
    gone = gone.withColumnsRenamed(names)
    return kept.join(gone, (F.col("load") == F.col("gone_load")) & F.col(airport_col).eqNullSafe(F.col("gone_airport"))
                     & F.col("ingest_seq").eqNullSafe(F.col("gone_seq")), "left_anti")


def syncs(spark: SparkSession, root: str, loads: list[str]) -> DataFrame:
    return spark.read.schema(SYNCS).parquet(f"{root}/syncs").filter(F.col("load").isin(loads))


def record_syncs(load_syncs: DataFrame, root: str, load: str) -> None:
    load_syncs.select("airport_iata", "ingest_seq", F.lit(load).alias("load")).distinct().write.mode("append").partitionBy(
        "load").parquet(f"{root}/syncs")


def commit_load(spark: SparkSession, root: str, load: str, replacing: bool = False) -> None:
    """Let ``load`` count; with ``replacing``, the older rows of its syncs (``record_syncs``) no longer do."""

    def change(ledger: DataFrame) -> DataFrame:
        added = spark.range(1).select(F.lit(load).alias("load"), F.lit(False).alias("gone"), F.lit(None).cast("string").alias("airport_iata"),
                                      F.lit(None).cast("long").alias("ingest_seq"))
        if replacing:
            loads, _ = live_of(ledger)
            own = syncs(spark, root, [load]).select(F.col("airport_iata").alias("a"), F.col("ingest_seq").alias("s"))
            old = syncs(spark, root, [x for x in loads if x != load])
            gone = old.join(own, F.col("airport_iata").eqNullSafe(F.col("a")) & F.col("ingest_seq").eqNullSafe(F.col("s")), "left_semi")
            added = added.unionByName(gone.withColumn("gone", F.lit(True)))
        return ledger.unionByName(added).distinct().coalesce(1)

    versions.replace(spark, f"{root}/loads", LEDGER, change)


def merge_loads(spark: SparkSession, root: str, merged: list[str], load: str, before: DataFrame | None) -> None:
    """Let ``load``, made without the replaced syncs ``before``, stand for the loads ``merged``.

    A sync of theirs that was replaced meanwhile is gone from ``load`` too.
    """

    def change(ledger: DataFrame) -> DataFrame:
        old = F.col("load").isin(merged)
        later = ledger.filter(F.col("gone") & old)
        if before is not None:
            later = later.exceptAll(before.withColumn("gone", F.lit(True)).select(*LEDGER.names))
        later = later.withColumn("load", F.lit(load))
        added = spark.range(1).select(F.lit(load).alias("load"), F.lit(False).alias("gone"), F.lit(None).cast("string").alias("airport_iata"),
                                      F.lit(None).cast("long").alias("ingest_seq"))
        return ledger.filter(~old).unionByName(later).unionByName(added).distinct().coalesce(1)

    versions.replace(spark, f"{root}/loads", LEDGER, change)
