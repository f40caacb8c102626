"""Loading of the claims tables: typed CSV scan, rejects, keys, row counts."""

from __future__ import annotations

import csv
import logging
from collections.abc import Iterable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions.periods import Tables
from claimspark.sources.records import PLACE, PLACE_TYPE, headers, literal, odd_quotes, placed_lines, placed_records
from claimspark.sources.schemas import PRIMARY_KEYS, SCHEMAS

logger = logging.getLogger(__name__)

NULL_TOKEN = "NULL"
CORRUPT = "_corrupt_record"
# Endings that a table's file may have; a backup beside it is not read.
ENDINGS = ("", ".gz", ".bz2", ".deflate", ".zst", ".snappy", ".lz4")

# An empty field and the token NULL are both read as null, for every type.
_CSV = {
    "quote": '"',
    "escape": '"',
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "nullValue": NULL_TOKEN,
    "emptyValue": NULL_TOKEN,
}


def _typed(table: str, header: Iterable[str]) -> T.StructType:
    """The schema of a file with this header: known columns typed, unknown ones as text."""
    known = {f.name.lower(): f for f in SCHEMAS[table].fields}
    names = [name.strip().lower() for name in header]
    if len(set(names)) < len(names) or not known.keys() & set(names):
        raise ValueError(f"not a header of {table}: {list(header)}")
    unknown = [name for name in names if name not in known]
    missing = [name for name in known if name not in names]
    if unknown or missing:
        logger.warning("table %s: unknown columns %s left out, missing columns %s null", table, unknown, missing)
    fields = [T.StructField(known[n].name, known[n].dataType) if n in known else T.StructField(n, T.StringType()) for n in names]
    return T.StructType([*fields, T.StructField(CORRUPT, T.StringType())])


def _in_order(parsed: DataFrame, table: str, there: Iterable[str]) -> DataFrame:
    """The table's columns in their order, absent ones null, the marked bad records and the rows' places."""
    columns = [
        (F.col(f"_row.{f.name}") if f.name in there else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMAS[table].fields
    ]
    return parsed.select(*columns, CORRUPT, PLACE)


def parse_records(records: DataFrame, table: str, header: str) -> DataFrame:
    """Records (``value``, ``_place``) of files with this header as rows of the table, bad ones marked.

    Values are taken by the header's names. A record whose quotes do not close is bad. The
    header, one for each file and wherever it is repeated, and blank lines are passed over.
    """
    schema = _typed(table, next(csv.reader([header.lstrip("\ufeff")])))
    line = F.col("value")
    parsed = (
        records.where((line != header) & (F.trim(line) != ""))
        # a generated column: filters on it stay above, so that a record is parsed once
        .select("value", PLACE, F.explode(F.array(F.from_csv(line, _ddl(schema), _CSV))).alias("_row"))
        .withColumn(CORRUPT, F.when(odd_quotes("value"), line).otherwise(F.col(f"_row.{CORRUPT}")))
    )
    return _in_order(parsed, table, schema.names)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)


def scan_csv(spark: SparkSession, table: str, path: str | list[str], *, multi_line: bool = False) -> DataFrame:
    """All rows of a table's CSV files, bad ones marked in ``_corrupt_record``, with their place in ``_place``.

    Columns are found by the names in each file's header, whatever their order and letter
    case: files with the same header are one scan. With ``multi_line`` quoted values may hold
    line breaks; large files are still read by many tasks.
    """
    known = headers(spark, path)
    files: dict[str, list[str]] = {}
    for file, header in sorted(known.items()):
        files.setdefault(header, []).append(file)
    if not files:
        return _in_order(spark.createDataFrame([], f"{CORRUPT} string, {PLACE} {PLACE_TYPE}"), table, [])
    read = placed_records if multi_line else placed_lines
    return reduce(
        DataFrame.unionByName,
        # a path is listed once for all of its files; groups of files are named
        [
            parse_records(read(spark, path if len(files) == 1 else [literal(f) for f in own]), table, header)
            for header, own in files.items()
        ],
    )


def split_rejects(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected lines): a bad line is set aside and does not stop the load.

    A record is parsed with all its columns, so that it is good or bad whatever is selected.
    """
    return scanned.where(F.col(CORRUPT).isNull()).drop(CORRUPT), scanned.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn the exact strings '' and 'NULL' into nulls, for sources other than CSV."""
    return df.select(
        *[
            F.when(~F.col(f.name).isin("", NULL_TOKEN), F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def _no_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def keep_first(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order`` (default: all remaining columns).

    A row whose key is not complete has no key and stays, as in a table whose key
    column takes nulls; ``constraint_report`` counts it. Rank 1 is applied on the map
    side before the shuffle, so a key with very many copies sends at most one row per
    input partition.
    """
    ties = order if order is not None else [c for c in df.columns if c not in keys]
    own = F.when(_no_key(keys), F.monotonically_increasing_id())
    ranked = Window.partitionBy(*keys, "_own").orderBy(*(ties or keys))
    numbered = df.withColumn("_own", own).withColumn("_rank", F.row_number().over(ranked))
    return numbered.where("_rank = 1").drop("_rank", "_own")


def new_rows(
    incoming: DataFrame, existing: DataFrame, keys: list[str], order: list[str] | None = None
) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``existing``, one per key.

    A row whose key is not complete is new unless ``existing`` has one that is equal to
    it in all columns that both have, so a repeated load does not add it again.
    """
    first = keep_first(incoming, keys, order)
    keyed = first.where(~_no_key(keys)).join(existing.select(*keys), keys, "left_anti")
    both = [c for c in incoming.columns if c in existing.columns]
    known = existing.where(_no_key(keys)).select(*[F.col(c).alias(f"_known_{c}") for c in both])
    equal = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_known_{c}")) for c in both])
    return keyed.unionByName(first.where(_no_key(keys)).join(known, equal, "left_anti"))


def load_tables(
    spark: SparkSession, path: str, names: Iterable[str] | None = None, *, multi_line: bool = False
) -> dict[str, DataFrame]:
    """Read ``<path>/<table>.csv`` (a file, compressed or not, or a folder) for every table found.

    ``names`` limits the load to some of the five tables; ``multi_line`` allows line
    breaks in quoted values.

    A missing table is logged and left out. Rows with a bad value are left out
    (see ``load_rejects``), and of each primary key the row is kept that stands first: in
    the first of its files by name, on the first line there. Any path that Hadoop can read
    will do, object stores included.
    """
    tables: dict[str, DataFrame] = {}
    for table in PRIMARY_KEYS if names is None else names:
        try:
            scanned = scan_csv(spark, table, f"{path}/{table}.csv{{{','.join(ENDINGS)}}}", multi_line=multi_line)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            logger.warning("no file for table %s under %s, skipped", table, path)
            continue
        tables[table] = keep_first(split_rejects(scanned)[0], PRIMARY_KEYS[table], [PLACE]).drop(PLACE)
    return tables


def load_rejects(spark: SparkSession, table: str, path: str, *, multi_line: bool = False) -> DataFrame:
    """Lines of a table's CSV that do not fit its schema."""
    return split_rejects(scan_csv(spark, table, path, multi_line=multi_line))[1]


def table_counts(tables: Tables) -> DataFrame:
    """(tbl, rows) for every table, as one job."""
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tbl"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)
