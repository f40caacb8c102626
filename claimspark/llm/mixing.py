"""Mixing sources by temperature: target weights, then a plan of blocks that meets them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise

#: Rows of one group when places are counted.
BUCKET_ROWS = 4_000
WORD = r"[^\x20\x09-\x0D]+"


def bisect(meets: Callable[[float], bool], steps: int = 24) -> float:
    """The exponent in [0, 1], to 2**-steps, from which on ``meets`` holds (it holds for 1)."""
    low, high = 0.0, 1.0
    if meets(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if meets(middle) else (middle, high)
    return high


def exponent_for_repetition(smallest: int, largest: int, limit: float) -> float:
    """The least exponent with which no source is repeated more than ``limit`` times as often as the largest."""
    if limit < 1:
        raise ValueError("a repetition limit is at least 1")
    return bisect(lambda a: (largest / smallest) ** (1 - a) <= limit * (1 + 1e-12))


def exponent_for_entropy(sources: DataFrame, entropy: float) -> float:
    """The least exponent whose weights have an entropy (in nats) of at most ``entropy``.

    Each step is one aggregate over the table of sources; nothing else comes back.
    """
    scale = math.log(sources.agg(F.max("tokens")).first()[0])

    def meets(a: float) -> bool:
        z = F.exp(a * (F.log("tokens") - scale))
        row = sources.agg(F.sum(z).alias("z"), F.sum(z * a * (F.log("tokens") - scale)).alias("s")).first()
        return math.log(row["z"]) - row["s"] / row["z"] <= entropy + 1e-12

    return bisect(meets)


def source_tokens(rows: DataFrame) -> DataFrame:
    """Tokens and documents of each source (null is a source)."""
    return rows.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"))


def schedule(
    docs: DataFrame,
    repetition: float = 2.0,
    entropy: float | None = None,
    total_tokens: int | None = None,
    block_tokens: int = 1 << 20,
    seed: str = "mix",
) -> DataFrame:
    """The mixture as rows (row_a, row_b, doc_id, source, tokens, epoch, block, start).

    A source's weight is its share of tokens to the power of an exponent, normalised.
    The exponent is bisected: the least that repeats no source more than ``repetition``
    times, or, with ``entropy`` (nats), the least that brings the weights' entropy down to
    it. Without ``total_tokens`` the mixture is as long as it takes for every document to
    occur, the largest source once; with it, each source gets its weight's share.

    Each epoch of a source is a permutation of its documents by a hash. They follow
    each other until the source's budget is used up (the last may exceed it by less
    than a document). The mixture is cut into blocks of ``block_tokens``: a document's
    block is the budget share at its ``start``, so each block holds the weights, but for a
    document of each source at its edges.

    Tokens are words (ASCII white space between them) of the whole text, plus one for its
    end: so null and empty texts have 1. A null source is a source of its own, a null
    doc_id stays null, and repeated rows are documents each (they share a place in the
    order). An empty table gives an empty result.

    A source is permuted in buckets of the hash: sums of bucket sizes give each bucket's
    start, and running sums stay within a bucket, so a source that holds most rows is
    spread over many tasks.
    """
    rows = materialise(with_row(docs), "mix_rows")
    own = materialise(source_tokens(rows), "mix_sources")
    facts = own.agg(F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.sum("documents").alias("n")).first()
    if facts["n"] is None:
        budgets = own.select("source", "tokens", F.col("tokens").alias("budget"))
        a, documents = 1.0, 0
    else:
        a = exponent_for_repetition(facts["low"], facts["high"], repetition) if entropy is None else exponent_for_entropy(own, entropy)
        a, documents = math.ceil(a * 1e6 - 1e-3) / 1e6, facts["n"]
        # the largest source once; the others by their weights
        share = F.exp(a * F.log("tokens") + (1 - a) * math.log(facts["high"]))
        if total_tokens is not None:
            share = share * (total_tokens / own.agg(F.sum(share)).first()[0])
            budget = F.round(share).cast("long")
        else:
            budget = F.greatest(F.round(share).cast("long"), F.col("tokens"))
        budgets = own.select("source", "tokens", budget.alias("budget"))
    budgets = materialise(budgets.select("source", F.col("tokens").alias("source_tokens"), "budget"), "mix_budgets")
    blocks = max(1, math.ceil((budgets.agg(F.sum("budget")).first()[0] or 0) / block_tokens))

    digits = max(0, math.ceil(math.log(max(documents, 1) / BUCKET_ROWS, 16))) if documents > BUCKET_ROWS else 0
    epochs = F.ceil(F.col("budget") / F.col("source_tokens")).cast("int")
    named = rows.join(budgets, rows["source"].eqNullSafe(budgets["source"])).drop(budgets["source"])
    dealt = named.select("*", F.explode(F.sequence(F.lit(0), epochs - 1)).alias("epoch")) if documents else named.withColumn("epoch", F.lit(0))
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), "name"))
    dealt = dealt.withColumn("order", order).withColumn("bucket", F.substring("order", 1, digits) if digits else F.lit(""))
    keys = ["source", "epoch", "bucket"]
    ahead = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys).agg(F.sum("tokens").alias("held"))
    first = sums.select(*[F.col(k).alias(f"b_{k}") for k in keys], F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"))
    within = Window.partitionBy(*keys).orderBy("order", "row_a", "row_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    same = placed["source"].eqNullSafe(first["b_source"]) & (placed["epoch"] == first["b_epoch"]) & (placed["bucket"] == first["b_bucket"])
    start = F.col("epoch") * F.col("source_tokens") + F.col("before") + F.col("inside")
    return (
        placed.join(first, same)
        .withColumn("start", start)
        .where(F.col("start") < F.col("budget"))
        .withColumn("block", F.floor(F.col("start").cast("decimal(38,0)") * blocks / F.col("budget")).cast("long"))
        .select("row_a", "row_b", "doc_id", "source", "tokens", "epoch", "block", "start")
    )


def with_row(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens, the name that the permutation hashes, and two hashes that tell different rows apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        (F.regexp_count(text, F.lit(WORD)).cast("long") + 1).alias("tokens"),
        F.coalesce(F.col("doc_id").cast("string"), F.md5(text)).alias("name"),
        *row_keys(docs),
    )


def row_keys(docs: DataFrame) -> list:
    """Two hashes of all columns: rows that share them are equal."""
    values = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return [F.xxhash64(*values).alias("row_a"), F.xxhash64(F.lit("b"), *values[::-1]).alias("row_b")]


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture that ``schedule`` plans, as rows of ``docs``: each as often as it is planned, columns unchanged.

    Rows come in blocks: those of a block are together and in the order of their place.

    Nulls, empty and long texts, repeated rows, ties and empty tables are as in ``schedule``:
    a null or empty text has one token, a null source is a source, of equal rows the plan's
    number is returned. Columns may have any names and are kept.

    The plan holds no texts. Of equal rows one is kept before the shuffle and repeated by
    the plan, so that a row that repeats very often is not gathered.
    """
    planned = schedule(docs, **options).select("row_a", "row_b", F.col("block").alias("mix_block"), F.col("start").alias("mix_start"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_doc"), *row_keys(docs))
    same = Window.partitionBy("row_a", "row_b").orderBy(F.lit(0))
    once = whole.withColumn("mix_copy", F.row_number().over(same)).where("mix_copy = 1")
    placed = once.join(planned, ["row_a", "row_b"]).select("mix_doc", "mix_block", "mix_start")
    return placed.repartition("mix_block").sortWithinPartitions("mix_block", "mix_start").select("mix_doc.*")
