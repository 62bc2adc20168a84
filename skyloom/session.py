"""Session settings and the shared folder that jobs may write intermediate tables to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def build_session(
    app_name: str = "skyloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with the settings the plans rely on.

    Adaptive execution is what keeps the plans safe at size: it splits skewed join partitions, merges
    small shuffle partitions and turns a shuffled join into a broadcast one only after measuring the
    side. ``shuffle_partitions`` is the starting number; give a few times the number of cores, or
    total shuffle bytes / 200 MB when that is larger, and let adaptive execution merge them. A stage whose
    generated method passes the size the JVM compiles is run operator by operator instead.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.codegen.hugeMethodLimit": "8000",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in {**settings, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one job under the cluster's ``spark.checkpoint.dir``.

    Without that setting a local session gets a temporary folder; on a cluster the call fails, because
    a folder on one machine is not visible to the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = tempfile.mkdtemp(prefix="skyloom-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: a stage that outlives its executors."""
    path = shared_dir(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table. Unlike ``createDataFrame([])`` it starts no Python worker."""
    return spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema])
