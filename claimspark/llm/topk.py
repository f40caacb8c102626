"""Exact top-k search by inner product of whole-number vectors, with cover trees on both sides."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise
from claimspark.llm.cover_tree import CoverTree, search
from claimspark.llm.vectors import SAMPLE, finite, first_by_hash, matrix

#: Candidates of a cell's part, queries of a group, top balls of the cover tree at most.
CELL, GROUP, PIVOTS = 8192, 4096, 256
#: Scores beyond this are not whole numbers in doubles.
EXACT = 2**53

RESULT = "query_id long, vec_id long, score long"


def scaled(vector: str, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("double"))


def _pivots(sample: np.ndarray, number: int) -> np.ndarray:
    """Centres that are far from each other: each next one is the sample's farthest from those before."""
    chosen = [sample[0]]
    nearest = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < number and nearest.max() > 0:
        chosen.append(sample[nearest.argmax()])
        nearest = np.minimum(nearest, np.linalg.norm(sample - chosen[-1], axis=1))
    return np.array(chosen)


def _thresholds(queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the sampled candidates, a lower bound of that among all."""
    if len(sample) <= k:
        return np.full(len(queries), -np.inf)
    known = queries @ sample.T
    known[ids[:, None] == sample_ids[None, :]] = -np.inf
    return np.partition(known, -k, axis=1)[:, -k]


def _search(points: DataFrame, queries: DataFrame, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the best of each query in each part of the candidates that can hold one."""
    spark, total = points.sparkSession, points.count()
    held = first_by_hash(points, ["vec_id", "vector"], total, SAMPLE).select("vec_id", "vector").collect()
    sample = np.array([row["vector"] for row in held], float).reshape(-1, dims)
    sample_ids = np.array([row["vec_id"] for row in held], np.int64)
    pivots = _pivots(sample, min(PIVOTS, max(1, total // CELL)))

    def nearest(rows: np.ndarray) -> np.ndarray:
        return ((pivots**2).sum(1) - 2 * rows @ pivots.T).argmin(1).astype(np.int32)

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("vector"), dims)
            cell = nearest(rows)
            far = np.linalg.norm(rows - pivots[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = materialise(points.mapInArrow(place, "vec_id long, vector array<double>, cell int, far double"), "cells")
    balls = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()  # at most PIVOTS rows
    cells = sorted(row["cell"] for row in balls)
    parts = {row["cell"]: math.ceil(row["n"] / CELL) for row in balls}
    radii = {row["cell"]: row["radius"] for row in balls}
    centres, reach = pivots[cells], np.array([radii[cell] for cell in cells])

    def ask(batches) -> Iterator[pa.RecordBatch]:
        """Each query with its threshold, for every cell whose ball may hold a score that reaches it."""
        for batch in batches:
            rows, ids = matrix(batch.column("vector"), dims), batch.column("vec_id").to_numpy()
            least = _thresholds(rows, ids, sample, sample_ids, k)
            inner, slack = rows @ centres.T, np.linalg.norm(rows, axis=1)[:, None] * reach[None, :]
            bound = inner + slack + 1e-9 * (np.abs(inner) + slack) + 1e-6
            row, cell = np.nonzero(bound >= least[:, None])
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(taken), batch.column("vector").take(taken), pa.array(least[row]),
                 pa.array(nearest(rows)[row]), pa.array(np.array(cells, np.int32)[cell])],
                names=["vec_id", "vector", "least", "side", "cell"],
            )

    asking = materialise(queries.mapInArrow(ask, "vec_id long, vector array<double>, least double, side int, cell int"), "asking")
    # queries near one pivot are one group, or several of some GROUP
    sides = {row["side"]: math.ceil(row["n"] / GROUP) for row in asking.groupBy("side").agg(F.count_distinct("vec_id").alias("n")).collect()}
    numbers = [(cell, n) for cell, n in parts.items()] or [(-1, 1)]
    parts_of = F.broadcast(spark.createDataFrame(numbers, "cell int, parts int"))  # at most PIVOTS rows, as below
    groups_of = F.broadcast(spark.createDataFrame([(side, n) for side, n in sides.items()] or [(-1, 1)], "side int, groups int"))
    group = F.pmod(F.xxhash64("vec_id"), F.col("groups")).cast("int").alias("group")
    own = asking.join(groups_of, "side").join(parts_of, "cell").select(
        F.lit(True).alias("asks"), "vec_id", "vector", "least", "side", group, "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    )
    # a cell goes to the groups that ask for it: at most PIVOTS cells for each group of some GROUP queries
    met = F.broadcast(asking.select("side", "cell").distinct().join(groups_of, "side"))
    part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
    groups = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
    side = placed.join(met, "cell").join(parts_of, "cell").select(
        F.lit(False).alias("asks"), "vec_id", "vector", F.lit(None).cast("double").alias("least"), "side", groups, "cell", part
    )

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
        rows, ids = matrix(table.column("vector"), dims), table.column("vec_id").to_numpy()
        names, least = ids[asks], table.column("least").to_numpy()[asks].astype(float)
        found = search(CoverTree(rows[asks]), names, CoverTree(rows[~asks]), ids[~asks], k, least)
        place, rank = np.nonzero(found.scores > -np.inf)
        return pa.table({
            "query_id": names[place], "vec_id": found.ids[place, rank], "score": found.scores[place, rank].astype(np.int64),
        })

    keys = ["side", "group", "cell", "part"]
    number = max(1, sum(parts.values()) * sum(sides.values()))
    return own.unionByName(side).repartition(number, *keys).groupBy(*keys).applyInArrow(best, RESULT)


def top_k(rows: DataFrame, queries: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id", factor: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the ``k`` largest scores.

    The score is the inner product of the vectors after floor(factor * x); equal scores
    go to the smaller vec_id; all other rows are candidates, and fewer than ``k`` give all.
    Results are exact: whole numbers, which must stay below 2**53 in size.

    Candidates are cells around far-apart pivots, in parts of some 8,192, queries groups of
    some 4,096 near one pivot. Each query's k-th score among a bounded sample of candidates
    is taken once. A query is sent only to cells whose ball may hold a score that reaches it,
    and a cell to the groups that ask for it; there the dual-tree search starts from those
    scores, so a part returns only what may still be among the best.

    Vectors that are null, empty or hold null or non-finite components, and rows
    without a key, take no part; vectors of different lengths are not compared.
    Repeated rows are one row; rows that share a query's key are not its candidates; of
    different vectors under one key the query takes the smallest. An empty table gives
    an empty result; other columns are left out.
    """
    usable = finite(vector) & F.col(key).isNotNull()
    base = rows.where(usable).select(
        F.col(key).cast("long").alias("vec_id"), scaled(vector, factor).alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks")
    )
    base = materialise(base.distinct(), "scaled")
    asked = materialise(base.where("asks").groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    points = base.select("vec_id", "vector")
    found = None
    for row in points.select(F.size("vector").alias("dims")).distinct().collect():  # mostly one
        own = _search(
            points.where(F.size("vector") == row["dims"]), asked.where(F.size("vector") == row["dims"]), row["dims"], k
        )
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = rows.sparkSession.createDataFrame([], RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
