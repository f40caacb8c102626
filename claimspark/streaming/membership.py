"""Which parts of a keyed table may hold a key: ranges and Bloom filters, kept beside the table.

A part is what one load added to one hash bucket. The index has a row for each part (rows,
smallest and largest key) and the words of its filter that are not zero. It never misses a
key that is there, so a batch compares its keys with the rows of the parts that it names only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise

BUCKET, LOAD = "key_bucket", "load"
#: Bits of a filter for each key, and bits that a key sets: one key in some 1,700 is found by chance.
BITS, PROBES = 16, 8
#: From so many keys in a bucket on, chance hits make probing a part pointless: it is read.
PROBED = 1_700

_PART = f"{LOAD} int, {BUCKET} int, rows long, words long, low string, high string"
_WORD = f"{LOAD} int, {BUCKET} int, word long, bits long"


def key_bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _texts(keys: list[str]) -> list[Column]:
    """A key's values as text; a null is a value as well."""
    return [F.coalesce(F.col(k).cast("string"), F.lit("\0")) for k in keys]


def _places(keys: list[str]) -> Column:
    """The bits that a key sets in a filter of ``words`` words, as (word, bit)."""
    size = F.col("words") * 64
    hashes = [F.pmod(F.xxhash64(F.lit(n), *_texts(keys)), size) for n in range(PROBES)]
    return F.array(*[F.struct(F.floor(h / 64).alias("word"), F.pmod(h, F.lit(64)).cast("int").alias("bit")) for h in hashes])


def add_to_index(rows: DataFrame, keys: list[str], index: str) -> None:
    """Add the parts of ``rows`` (the keys, ``key_bucket``, ``load``), which the index must not have yet."""
    first = _texts(keys)[0]
    parts = rows.groupBy(LOAD, BUCKET).agg(
        F.count(F.lit(1)).alias("rows"),
        F.ceil(F.count(F.lit(1)) * BITS / 64).alias("words"),
        F.min(first).alias("low"),
        F.max(first).alias("high"),
    )
    parts = materialise(parts.coalesce(1), "index_parts")  # a row a part
    set_bits = rows.join(parts.select(LOAD, BUCKET, "words"), [LOAD, BUCKET]).select(LOAD, BUCKET, F.explode(_places(keys)).alias("at"))
    words = set_bits.groupBy(LOAD, BUCKET, F.col("at.word").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, at.bit)")).alias("bits"))
    # the words first: a part is known when all of its filter is there
    words.repartition(LOAD, BUCKET).sortWithinPartitions(LOAD, BUCKET, "word").write.mode("append").partitionBy(LOAD).parquet(f"{index}/words")
    parts.write.mode("append").parquet(f"{index}/parts")


def known_parts(spark: SparkSession, index: str) -> DataFrame:
    """A row for each part: load, key_bucket, rows, words, low, high."""
    return spark.read.schema(_PART).parquet(f"{index}/parts")


def create_index(spark: SparkSession, index: str) -> None:
    """An empty index, unless there is one."""
    spark.createDataFrame([], _PART).write.mode("ignore").parquet(f"{index}/parts")
    spark.createDataFrame([], _WORD).write.mode("ignore").partitionBy(LOAD).parquet(f"{index}/words")


def parts_that_may_hold(spark: SparkSession, index: str, batch: DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """(load, key_bucket) of all parts that may hold a key of ``batch`` (the keys, ``key_bucket``).

    Ranges are compared first, one row a bucket with one row a part. The parts that are left
    are probed key by key where the bucket has fewer than ``PROBED`` keys, and named without
    probing elsewhere. What comes back is at most a pair for each part.
    """
    first = _texts(keys)[0]
    ranges = batch.groupBy(BUCKET).agg(
        F.min(first).alias("batch_low"), F.max(first).alias("batch_high"), F.count(F.lit(1)).alias("batch_rows")
    )
    near = known_parts(spark, index).join(ranges, BUCKET).where("low <= batch_high and high >= batch_low")
    near = near.select(LOAD, BUCKET, "words", "low", "high", (F.col("batch_rows") < PROBED).alias("probe")).collect()
    named = {(r[LOAD], r[BUCKET]) for r in near if not r["probe"]}
    probed = [(r[LOAD], r[BUCKET], r["words"], r["low"], r["high"]) for r in near if r["probe"]]
    if not probed:
        return sorted(named)
    parts = spark.createDataFrame(probed, f"{LOAD} int, {BUCKET} int, words long, low string, high string")
    wanted = batch.select(BUCKET, *keys).distinct().join(parts, BUCKET).where(first.between(F.col("low"), F.col("high")))
    name = F.xxhash64(*_texts(keys)).alias("name")
    asked = wanted.select(LOAD, BUCKET, name, F.explode(_places(keys)).alias("at")).select(LOAD, BUCKET, "name", "at.word", "at.bit")
    words = spark.read.schema(_WORD).parquet(f"{index}/words").where(F.col(LOAD).isin(sorted({p[0] for p in probed})))
    found = asked.join(words, [LOAD, BUCKET, "word"]).where(F.expr("(bits & shiftleft(1L, bit)) != 0"))
    hits = found.groupBy(LOAD, BUCKET, "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= PROBES)
    return sorted(named | {(r[LOAD], r[BUCKET]) for r in hits.select(LOAD, BUCKET).distinct().collect()})
