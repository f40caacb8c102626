"""Incremental load: files that arrived since the last run, each loaded once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimspark.functions.scratch import materialise, materialise_with
from claimspark.sources.load import new_rows, scan_csv, split_rejects
from claimspark.sources.records import PLACE, literal
from claimspark.sources.schemas import PRIMARY_KEYS, SCHEMAS
from claimspark.streaming.membership import BUCKET, LOAD, add_to_index, create_index, key_bucket, known_parts, parts_that_may_hold

# Parts of the target by a hash of the key; a batch reads only parts that its keys fall in.
BUCKETS = 64


def _stored(table: str) -> T.StructType:
    return T.StructType([*SCHEMAS[table].fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(LOAD, T.IntegerType())])


def target_rows(spark: SparkSession, table: str, target: str, parts: list[tuple[int, int]] | None = None) -> DataFrame:
    """The target's rows; with ``parts`` (load, key_bucket) only theirs."""
    reader = spark.read.schema(_stored(table)).option("basePath", target)
    if parts is None:
        return reader.parquet(target).select(*SCHEMAS[table].names)
    paths = [f"{target}/{BUCKET}={bucket}/{LOAD}={load}" for load, bucket in parts]
    if not paths:
        return spark.createDataFrame([], SCHEMAS[table])
    # a part that was announced and never written is not there
    return reader.option("ignoreMissingFiles", True).parquet(*_there(spark, paths)).select(*SCHEMAS[table].names)


def _there(spark: SparkSession, paths: list[str]) -> list[str]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    files = hadoop(paths[0]).getFileSystem(configuration)
    return [path for path in paths if files.exists(hadoop(path))]


def append_new(
    spark: SparkSession, table: str, rows: DataFrame, target: str, index: str, buckets: int = BUCKETS, order: list[str] | None = None
) -> list[tuple[int, int]]:
    """Append the rows whose key the target does not hold, one per key, and return the parts that were read for it.

    The index names the parts that may hold the batch's keys; only their rows are compared.
    New parts are entered in the index before they are written: if the write fails, the index
    names parts without rows, and no row is ever outside the index.
    """
    keys, names = PRIMARY_KEYS[table], SCHEMAS[table].names
    incoming = rows.withColumn(BUCKET, key_bucket(keys, buckets))
    parts = parts_that_may_hold(spark, index, incoming, keys)
    known = target_rows(spark, table, target, parts)
    fresh = new_rows(rows, known, keys, order).select(*names)
    last = known_parts(spark, index).agg(F.max(LOAD)).first()[0]
    number = F.lit(0 if last is None else last + 1)
    fresh = fresh.withColumn(BUCKET, key_bucket(keys, buckets)).withColumn(LOAD, number)
    fresh, seen = materialise_with(fresh, "fresh", rows=F.count(F.lit(1)))
    if not seen["rows"]:
        return parts
    add_to_index(fresh, keys, index)
    fresh.repartition(BUCKET).write.mode("append").partitionBy(BUCKET, LOAD).parquet(target)
    return parts


def create_target(spark: SparkSession, table: str, target: str, index: str) -> None:
    """An empty target with an empty index, unless they are there."""
    spark.createDataFrame([], _stored(table)).write.mode("ignore").partitionBy(BUCKET, LOAD).parquet(target)
    create_index(spark, index)


def ingest(
    spark: SparkSession,
    table: str,
    source: str,
    target: str,
    rejects: str,
    checkpoint: str,
    buckets: int = BUCKETS,
    index: str | None = None,
    multi_line: bool = False,
) -> StreamingQuery:
    """Append the new rows of a table's CSV folder to its Parquet folder and stop.

    The checkpoint remembers which files were loaded, so a repeated run loads only
    new ones. Within a batch the row of a key is kept that stands first in the files, and keys
    already in the target are left out. Lines that do not fit the schema go to
    ``<rejects>/batch=<number>``, which a batch that is run again replaces; its good rows
    it finds in the target. Files are read by their own headers. The target is partitioned by
    a hash of the key and must keep its number of ``buckets``; an index of its keys
    (``index``, by default beside it) says which parts of it a batch must read.
    """
    target = target.rstrip("/")
    index = index or f"{target}.index"
    create_target(spark, table, target, index)

    def append(files: DataFrame, number: int) -> None:
        session = files.sparkSession
        paths = [literal(row["path"], encoded=False) for row in files.collect()]  # a row for each new file
        if not paths:
            return
        parsed = materialise(scan_csv(session, table, paths, multi_line=multi_line), "ingest")
        good, bad = split_rejects(parsed)
        append_new(session, table, good, target, index, buckets, [PLACE])
        bad.write.mode("overwrite").text(f"{rejects}/batch={number}")

    # the stream is of the files' names; their content is left out of it and read once, by header
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return (
        names.load(source)
        .select("path")
        .writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
