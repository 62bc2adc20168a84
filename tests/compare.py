"""Compare a Spark result with DuckDB's: same columns, kinds and rows in any order.

Also a script: ``python tests/compare.py SF_DIR [name ...]``.
"""

from __future__ import annotations

import collections
import datetime
import decimal
import math
import os
import sys
import tempfile
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _value(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else float(f"{float(value):.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


def _kind(name: str) -> str:
    name = name.lower()
    for kind, starts in {
        "int": ("tinyint", "smallint", "int", "bigint", "hugeint"), "float": ("double", "float", "real", "decimal"),
        "text": ("string", "varchar"), "time": ("timestamp",), "date": ("date",), "bool": ("bool",),
    }.items():
        if name.startswith(starts):
            return kind
    return name


def differences(df, connection, sql: str) -> str | None:
    """What differs between the Spark DataFrame and the SQL result, or None."""
    relation = connection.sql(sql)
    expected_kinds = {c: _kind(str(t)) for c, t in zip(relation.columns, relation.types)}
    actual_kinds = {f.name: _kind(f.dataType.simpleString()) for f in df.schema}
    if expected_kinds != actual_kinds:
        return f"schema: spark {actual_kinds} sql {expected_kinds}"
    columns = sorted(expected_kinds)
    order = [relation.columns.index(c) for c in columns]
    expected = collections.Counter(tuple(_value(row[i]) for i in order) for row in relation.fetchall())
    actual = collections.Counter(tuple(_value(row[c]) for c in columns) for row in df.collect())
    if expected != actual:
        return (f"rows: spark {sum(actual.values())} sql {sum(expected.values())}; columns {columns}; "
                f"only spark {list((actual - expected).items())[:3]}; only sql {list((expected - actual).items())[:3]}")
    return None


def main() -> None:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sys.path.insert(0, root)
    import __spark_entry__ as entry
    from skyloom.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", shuffle_partitions=8,
                          conf={"spark.ui.enabled": "false", "spark.driver.memory": "8g",
                                "spark.checkpoint.dir": tempfile.mkdtemp(prefix="compare-")})
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = connect(sf_dir), entry.oracle_sql()
    queries = entry.queries()
    print("without SQL:", sorted(set(queries) - set(sql)), "without query:", sorted(set(sql) - set(queries)))
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            problem = differences(df, connection, sql[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.2f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
