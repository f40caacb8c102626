"""Run the registered queries on Spark and on DuckDB and compare the rows.

    python -m checks.compare [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

from checks.spark_queries import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimspark-checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values as text, rows sorted."""
    frame = frame[sorted(frame.columns)]

    def text(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "<null>"
        if hasattr(v, "date") and callable(v.date):
            v = v.date()
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.6f}" if str(getattr(v, "dtype", "")) != "bool" else str(bool(v))
        return str(v)

    rows = frame.astype(object).map(text)
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def compare(spark: SparkSession, db, sf_dir: str, name: str) -> str:
    """'' when equal, otherwise what differs."""
    frame = QUERIES[name](spark, sf_dir)
    types = {f.name: f.dataType.simpleString() for f in frame.schema.fields}
    actual = frame.toPandas()
    if name not in ORACLES:
        return f"rows only: {len(actual)}" if len(actual) else "no rows"
    relation = db.sql(ORACLES[name])
    names = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
             "DATE": "date", "BOOLEAN": "boolean"}
    expected_types = {c: names.get(str(t), str(t)) for c, t in zip(relation.columns, relation.types)}
    expected = relation.df()
    if types != expected_types and dict(sorted(types.items())) != dict(sorted(expected_types.items())):
        odd = {k: (types.get(k), expected_types.get(k)) for k in {*types, *expected_types}
               if types.get(k) != expected_types.get(k)}
        return f"schema {odd}"
    if len(actual) != len(expected):
        return f"rows {len(actual)} != {len(expected)}"
    a, b = normal(actual), normal(expected)
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"{int(bad.sum())} rows differ:\n{a[bad].head(3)}\n{b[bad].head(3)}"
    return ""


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    chosen = argv[1:] or list(QUERIES)
    spark, db, failed = session(), connect(sf_dir), 0
    for name in chosen:
        began = time.time()
        try:
            result = compare(spark, db, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            result = f"ERROR {type(error).__name__}: {str(error)[:1500]}"
        ok = not result or result.startswith("rows only")
        failed += not ok
        count = len(db.sql(ORACLES[name])) if ok and name in ORACLES else ""
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s {count} {result}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
