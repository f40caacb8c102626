"""Connected components of links that are held by Spark tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise, materialise_with


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node that it reaches.

    Each round hangs every node on its smallest neighbour, follows the pointers to
    their roots, and keeps the links between different roots. A root takes in at
    least one other node, so the number of rounds is logarithmic, and so is that of
    pointer steps in a round. Each step is a written table, so a lost executor costs
    no more than the step; counts of changes are all that comes to the driver. A
    node with very many links is pre-aggregated, then joined as a key that adaptive
    execution can split.
    """
    live, seen = _stored(links.select(F.col("a").cast("long"), F.col("b").cast("long")))
    maps: list[DataFrame] = []
    while seen["rows"]:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        roots = _roots(both.groupBy("a").agg(F.min("b").alias("b")))
        maps.append(roots)
        live, seen = _stored(_renamed(_renamed(live, roots, "a"), roots, "b"))
    if not maps:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    result = maps[0].withColumnRenamed("root", "component")
    for later in maps[1:]:
        step = later.select(F.col("node").alias("component"), "root")
        result = result.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
    return result


def _stored(links: DataFrame) -> tuple[DataFrame, dict]:
    """Each link between different nodes once, written, and how many there are."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    once = links.where(F.col("a") != F.col("b")).select(low.alias("a"), high.alias("b")).distinct()
    return materialise_with(once, "links", rows=F.count(F.lit(1)))


def _roots(nearest: DataFrame) -> DataFrame:
    """(node, root) after following smallest neighbours to the end."""
    pointers = materialise(nearest.select(F.col("a").alias("node"), F.least("a", "b").alias("root")), "pointers")
    while True:
        step = pointers.select(F.col("node").alias("root"), F.col("root").alias("above"))
        moved = pointers.join(step, "root").select(
            "node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")
        )
        moved, seen = materialise_with(moved, "pointers", moves=F.coalesce(F.sum(F.col("moved").cast("long")), F.lit(0)))
        pointers = moved.drop("moved")
        if not seen["moves"]:
            return pointers


def _renamed(links: DataFrame, roots: DataFrame, end: str) -> DataFrame:
    other = "b" if end == "a" else "a"
    return links.join(roots.withColumnRenamed("node", end), end).select(F.col("root").alias(end), other)
