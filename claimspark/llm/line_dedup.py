"""Lines that many documents share are dropped from all of them; DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise_with

#: ASCII white space, which is stripped from both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that holds more than one in so many of the common lines' places is looked up by broadcast: fewer lines than this.
HOT = 8192


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A to Z in lower case and nothing else changed."""
    bare = F.btrim(line, F.lit(SPACE))
    ascii_only = F.length(bare) == F.octet_length(bare)  # there, lower() changes A to Z only and is the faster one
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _hashes(key: Column) -> list[Column]:
    """128 bits of hash."""
    return [F.xxhash64(key).alias("line_a"), F.xxhash64(F.lit(1), key).alias("line_b")]


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def common_lines(docs: DataFrame, documents: int = 10, min_chars: int = 1) -> tuple[DataFrame, int]:
    """(line_a, line_b, documents, places) of keys found in at least ``documents`` documents, and the sum of places.

    A key is counted once for each doc_id (null is one, too), in two steps: a line that
    most documents share is a sum of partial counts, not a group in one task. ``places``
    counts all lines that have the key.
    """
    each = docs.select("doc_id", F.explode(_lines()).alias("line")).select("doc_id", line_key(F.col("line")).alias("key"))
    hashed = each.where(F.length("key") >= min_chars).select("doc_id", *_hashes(F.col("key")))
    once = hashed.groupBy("line_a", "line_b", "doc_id").agg(F.count(F.lit(1)).alias("places"))
    counted = once.groupBy("line_a", "line_b").agg(F.count(F.lit(1)).alias("documents"), F.sum("places").alias("places"))
    common, seen = materialise_with(
        counted.where(F.col("documents") >= documents), "common_lines", places=F.coalesce(F.sum("places"), F.lit(0))
    )
    return common, seen["places"]


def drop_common_lines(docs: DataFrame, documents: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row of ``docs`` (doc_id, text).

    A text is cut at each line feed. Lines are alike that have the same ``line_key``; those
    whose key has at least ``min_chars`` code points and is found in at least ``documents``
    documents are dropped everywhere, the other lines stay as they came, joined by line feeds.

    Lines meet by 128 bits of hash. The lines that hold most places go to all tasks, fewer
    than ``HOT`` of them; the others are joined on their hash, where no key is hot then.
    Only the places of dropped lines come back to their texts.

    A null or empty text is one empty line. Rows that share a doc_id, and all rows without
    one, are one document when documents are counted; each row has a result, repeated rows
    equal ones. A long text is a long list of lines in its own row, nothing more. Other
    columns are left out, whatever their names; an empty table gives an empty result.
    """
    rows = docs.select(
        "doc_id", "text",
        F.xxhash64("doc_id", "text").alias("row_a"), F.xxhash64("text", F.lit(1), "doc_id").alias("row_b"),
    )
    common, places = common_lines(docs, documents, min_chars)
    frequent = F.col("places") * HOT > places
    hot = common.where(frequent).select("line_a", "line_b", F.lit(True).alias("hot"))
    cold = common.where(~frequent).select("line_a", "line_b", F.lit(True).alias("cold"))
    each = rows.select("row_a", "row_b", F.posexplode(_lines()).alias("pos", "line"))
    placed = each.withColumn("key", line_key(F.col("line"))).where(F.length("key") >= min_chars)
    marked = placed.select("row_a", "row_b", "pos", *_hashes(F.col("key"))).join(F.broadcast(hot), ["line_a", "line_b"], "left")
    # what is known already need not meet anything, so it is dealt out by its place
    dealt = marked.withColumn("line_a", F.when(F.col("hot"), F.xxhash64("row_a", "pos")).otherwise(F.col("line_a")))
    gone = dealt.join(cold, ["line_a", "line_b"], "left").where(F.col("hot") | F.col("cold"))
    # a set of places, at most as many as the text has lines, also where the row is repeated
    lists = gone.groupBy("row_a", "row_b").agg(F.collect_set("pos").alias("dropped"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    joined = F.array_join(F.transform(kept, lambda at: F.element_at("lines", at + 1)), "\n")
    return (
        rows.join(lists, ["row_a", "row_b"], "left")
        .select("doc_id", "text", "dropped", _lines().alias("lines"))
        .select(
            "doc_id",
            F.size("lines").cast("long").alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
            F.when(F.col("dropped").isNull(), F.coalesce("text", F.lit(""))).otherwise(joined).alias("kept_text"),
        )
    )
