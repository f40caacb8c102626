"""Importance resampling: documents drawn by how much their n-grams look like those of a target.

Texts are bytes here. A table of 256 bytes lower-cases A to Z and turns every other
separator into a space, so that ``bytes.split`` yields the words; the CRC of a run of words
goes on from that of the run before it. Each task reduces its texts to one counter of
buckets.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise, materialise_with
from claimspark.llm.batches import as_bytes, slices

#: Bytes of a text whose words are held at a time.
PIECE = 1 << 20

#: Letters and digits of ASCII, in lower case, and all bytes above ASCII stay; what else there is parts words.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()


def _pieces(text: bytes, longest: int) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in lists; each begins with the last words of the one before, and how many those are."""
    plain, at, carried = text.translate(TABLE), 0, []
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        words = carried + plain[at:end].split()
        yield words, len(carried)
        carried = words[len(words) - min(longest - 1, len(words)) :]
        at = end


def features(text: bytes, longest: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text: its new words, and the buckets of all runs of 1 to ``longest`` words that end in them."""
    for words, carried in _pieces(text, longest):
        crcs = list(map(zlib.crc32, words))
        found = [crcs[carried:]]
        for length in range(2, longest + 1):
            crcs = list(map(zlib.crc32, words[length - 1 :], map(zlib.crc32, repeat(b" "), crcs)))
            found.append(crcs[max(0, carried - length + 1) :])
        yield len(words) - carried, np.concatenate([np.array(f, np.int64) for f in found]) % buckets


def bucket_counts(texts: DataFrame, longest: int = 2, buckets: int = 10_000) -> dict[int, int]:
    """How often each bucket occurs in all whole texts: at most ``buckets`` numbers, whatever the texts are."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in as_bytes(batch.column("text")):
                for _, found in features(text, longest, buckets):
                    counts.update(found.tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["bucket", "n"]
        )

    own = texts.select("text").mapInArrow(work, "bucket long, n long")
    return {row["bucket"]: row["n"] for row in own.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's share in the target to that in the documents, rounded down."""
    held, wanted = bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets)
    all_held, all_wanted = float(sum(held.values()) + buckets), float(sum(wanted.values()) + buckets)
    ratio = lambda b: (wanted.get(b, 0) + 1.0) * all_held / ((held.get(b, 0) + 1.0) * all_wanted)
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weights(docs: DataFrame, gains: np.ndarray, longest: int = 2) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs``: the floored mean of its features' gains."""
    buckets = len(gains)

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in as_bytes(batch.column("text")):
                words = number = total = 0
                for new, found in features(text, longest, buckets):
                    words += new
                    number += len(found)
                    total += int(gains[found].sum())
                rows.append((words, number, total // number if number else 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(column, pa.int64()) for column in zip(*rows))],
                names=["doc_id", "n_words", "n_features", "weight"],
            )

    schema = "doc_id long, n_words long, n_features long, weight long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 25,
    least_words: int = 20,
    longest: int = 2,
    buckets: int = 10_000,
    seed: int = 7,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of ``docs``; the drawn ones have a rank.

    Features are all runs of 1 to ``longest`` words, repeats counted, hashed to ``buckets``.
    A document's score is its weight plus Gumbel noise in thousandths, from a hash of
    ``seed`` and doc_id: so the highest scores are a draw without replacement with
    probabilities that follow the weights. Of the documents with at least ``least_words``
    words, ``percent`` of a hundred (rounded down) are drawn, ranked 1, 2, ... by falling
    score, ties to the smaller doc_id.

    A null or empty text has no features and weight 0. A null doc_id hashes like an empty
    one and comes after all others in a tie. Repeated rows are documents each: they share a
    score and have ranks that follow each other. A long text is read a piece at a time.
    Without target texts all shares there are equal. Other columns are left out, whatever
    their names; an empty table gives an empty result.

    The order is made by ranges of scores, written before they are numbered: a task sorts
    its range, and only the ranges' sizes are added up.
    """
    gains = bucket_gains(docs, target, longest, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296)))
    scored = weights(docs, gains, longest).withColumn("score", F.col("weight") + noise)
    # tells repeated rows apart, so that even they can fall into several ranges
    scored = scored.withColumn("copy", F.monotonically_increasing_id())
    able = F.col("n_words") >= least_words
    scored, seen = materialise_with(scored, "scores", able=F.coalesce(F.sum(able.cast("long")), F.lit(0)))
    ranked = _ranked(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("copy")])
    drawn = F.when(F.col("rank") <= percent * seen["able"] // 100, F.col("rank"))
    out = ["doc_id", "n_features", "weight", "score"]
    rest = scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*out, drawn.alias("rank")).unionByName(rest)


def _ranked(rows: DataFrame, order: list) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, ... in ``order``."""
    ranges = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    ranges = materialise(ranges, "ranges")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = ranges.groupBy("range").count().select("range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranges.withColumn("own", own).join(sizes, "range").withColumn("rank", F.col("before") + F.col("own"))


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``resample`` draws, all columns as they were.

    A doc_id that stands in several rows is drawn with all of them once one is.
    """
    found = resample(docs, target, **options).where(F.col("rank").isNotNull()).select(F.col("doc_id").alias("drawn_id")).distinct()
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("drawn_doc"))
    same = F.col("drawn_doc.doc_id").cast("long").eqNullSafe(F.col("drawn_id"))
    return held.join(found, same, "left_semi").select("drawn_doc.*")
