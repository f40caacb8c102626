"""Near-duplicate vectors: PCA-ordered comparison of tiles.

Unit vectors are turned so that the dimensions come in the order of their variance; a
turn keeps dot products. Two tiles are compared block by block: the product over the
leading dimensions plus the product of the norms of what is left bounds the cosine
from above (Cauchy-Schwarz), so pairs whose bound stays below the threshold are done
after a few dimensions. Tiles are ranges of the first coordinate, which differs by at
most sqrt(2 - 2 * threshold) between linked vectors: tiles farther apart never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise
from claimspark.llm.components import components
from claimspark.llm.spread import spanning
from claimspark.llm.vectors import SAMPLE, finite, first_by_hash, matrix, unit

#: Rows of a tile and of a block; shares of the dimensions after which pairs are given up.
TILE, BLOCK = 6144, 1024
LEADING = (0.375, 0.625)
#: Allowance for rounding in the bounds; the cosine itself decides.
SLACK = 1e-9


def principal_axes(sample: np.ndarray) -> np.ndarray:
    """Axes of unit vectors as columns, in descending order of variance; any turn gives right results."""
    if len(sample) < 2:
        return np.eye(sample.shape[1])
    return np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))[1][:, ::-1]


class Tile:
    """Vectors of a tile, turned; ``left`` and ``right`` hold what each stage adds to the bound of a pair.

    The bound after some dimensions is the product over them plus that of the norms of the rest. The
    product of two rows of a stage is the change of the bound: its dimensions, the rest behind
    it, less the rest behind the stage before. The last stage leaves no rest, so its bound is the cosine.
    """

    def __init__(self, vectors: np.ndarray, axes: np.ndarray) -> None:
        self.unit = unit(vectors)
        turned = self.unit @ axes
        dims = turned.shape[1]
        rest = np.sqrt(np.maximum(np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1], 0))
        rest = np.column_stack([rest, np.zeros(len(turned))])
        self.left, self.right, begin = [], [], 0
        for end in sorted({*(max(1, round(share * dims)) for share in LEADING), dims}):
            before = rest[:, begin] if begin else np.zeros(len(turned))
            self.left.append(np.column_stack([turned[:, begin:end], rest[:, end], -before]))
            self.right.append(np.column_stack([turned[:, begin:end], rest[:, end], before]))
            begin = end


def linked(a: Tile, b: Tile, rows: slice, columns: slice, threshold: float) -> np.ndarray:
    """Which pairs of a block have a cosine of at least ``threshold``.

    After each stage the block shrinks to the rows and columns that are still in a pair whose
    bound reaches the threshold; it is done when there are none.
    """
    bound = a.left[0][rows] @ b.right[0][columns].T
    near = np.zeros(bound.shape, bool)
    i, j = np.arange(rows.start, rows.stop), np.arange(columns.start, columns.stop)
    for left, right in zip(a.left[1:], b.right[1:]):
        still = bound >= threshold - SLACK
        up, along = np.flatnonzero(still.any(axis=1)), np.flatnonzero(still.any(axis=0))
        if not len(up):
            return near
        i, j, bound = i[up], j[along], bound[up[:, None], along]
        bound += left[i] @ right[j].T
    # cosines now, but for rounding: what lies at the threshold is decided by the vectors themselves
    found = bound >= threshold
    at, to = np.nonzero((bound >= threshold - SLACK) & (bound <= threshold + SLACK))
    found[at, to] = np.einsum("nd,nd->n", a.unit[i[at]], b.unit[j[to]]) >= threshold
    near[(i - rows.start)[:, None], j - columns.start] = found
    return near


def compare(ids: tuple[np.ndarray, np.ndarray], copies: tuple[np.ndarray, np.ndarray], tiles: tuple[Tile, Tile], same: bool, threshold: float):
    """Links of each vector of two tiles, weighted by copies, and pairs that join what is linked."""
    counts = (np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64))
    pairs = []
    for top in range(0, len(ids[0]), BLOCK):
        rows = slice(top, min(top + BLOCK, len(ids[0])))
        for at in range(top if same else 0, len(ids[1]), BLOCK):
            columns = slice(at, min(at + BLOCK, len(ids[1])))
            near = linked(*tiles, rows, columns, threshold)
            if same and at == top:
                near = np.triu(near, 1)
            if near.any():
                counts[0][rows] += near @ copies[1][columns]
                counts[1][columns] += copies[0][rows] @ near
                pairs.append(spanning(near, ids[0][rows], ids[1][columns]))
    return counts, np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)


def _links(points: DataFrame, dims: int, threshold: float, tile: int) -> DataFrame:
    """(a, b, n): pairs that join linked points (a, b), and the number of links n of point a in a pair of tiles."""
    total = points.count()
    drawn = first_by_hash(points, ["rep"], total, SAMPLE)
    sample = unit(np.array([row["vector"] for row in drawn.select("vector").collect()], float).reshape(-1, dims))
    axes = principal_axes(sample)
    first = np.sort(sample @ axes[:, 0])
    wanted = min(math.ceil(total / tile), len(first) // 8 or 1)
    cuts = np.unique(first[[len(first) * n // wanted for n in range(1, wanted)]])

    def place(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coordinate = unit(matrix(batch.column("vector"), dims)) @ axes[:, 0]
            bucket = np.searchsorted(cuts, coordinate, side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(bucket)], names=[*batch.schema.names, "bucket"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields) + ", bucket int"
    placed = materialise(points.mapInArrow(place, schema), "placed")
    # a bucket is a range of the first coordinate; one with too many rows is dealt to several tiles by a hash
    sizes = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}  # at most SAMPLE / 8 rows
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + SLACK
    low = [-np.inf, *cuts.tolist()]
    parts = {bucket: math.ceil(size / tile) for bucket, size in sizes.items()}
    number, tiles = {}, []
    for bucket in sorted(parts):
        number[bucket] = len(tiles)
        tiles += [bucket] * parts[bucket]
    high = [*cuts.tolist(), np.inf]
    # tiles are in the order of the coordinate, so that the partners of a tile are a range
    span = {
        bucket: (
            min(number[other] for other in parts if high[other] >= low[bucket] - reach),
            max(number[other] + parts[other] for other in parts if low[other] <= high[bucket] + reach) - 1,
        )
        for bucket in parts
    }
    plan = points.sparkSession.createDataFrame(
        [(bucket, number[bucket], parts[bucket], *span[bucket]) for bucket in parts] or [(-1, 0, 1, 0, 0)],
        "bucket int, first int, parts int, low int, high int",
    )
    own = F.col("first") + F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    partners = F.explode(F.sequence("low", "high")).alias("partner")
    dealt = (
        placed.join(F.broadcast(plan), "bucket")  # at most SAMPLE / 8 rows
        .select("rep", "copies", "vector", own.alias("tile"), "low", "high")
        .select("rep", "copies", "vector", "tile", partners)
        .select("rep", "copies", "vector", "tile", F.least("tile", "partner").alias("one"), F.greatest("tile", "partner").alias("two"))
    )

    def search(table: pa.Table) -> pa.Table:
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        tile_of = table.column("tile").to_numpy()
        rows = [np.flatnonzero(tile_of == t) for t in (one, two)]
        vectors = matrix(table.column("vector"), dims)
        ids, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        sides = [Tile(vectors[r], axes) for r in (rows[:1] * 2 if one == two else rows)]
        counts, pairs = compare(
            (ids[rows[0]], ids[rows[1]]), (copies[rows[0]], copies[rows[1]]), tuple(sides), one == two, threshold
        )
        a = np.concatenate([pairs[:, 0], ids[rows[0]], ids[rows[1]]])
        b = np.concatenate([pairs[:, 1], ids[rows[0]], ids[rows[1]]])
        n = np.concatenate([np.zeros(len(pairs), np.int64), *counts])
        kept = (a != b) | (n > 0)
        return pa.table({"a": a[kept], "b": b[kept], "n": n[kept]})

    pairs = len(tiles) * (len(tiles) + 1) // 2
    keyed = dealt.repartition(max(1, min(pairs, 16 * len(tiles))), "one", "two")
    return keyed.groupBy("one", "two").applyInArrow(search, "a long, b long, n long")


def near_duplicates(rows: DataFrame, threshold: float = 0.9, vector: str = "embedding", key: str = "vec_id", tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows``.

    Vectors link where the cosine of their double-precision components is at least
    ``threshold``; n_links counts the other rows linked directly, component_id is the
    smallest vec_id that links reach, and kept says whether it is the row's own.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without a vec_id, link with nothing; nor do vectors of different lengths link.
    Equal vectors are compared once and counted as often as they occur; different
    vectors of one vec_id are counted together. An empty table gives an empty result;
    other columns are left out.
    """
    own = F.when(F.col(key).isNotNull(), F.col(vector))
    base = rows.select(F.col(key).cast("long").alias("vec_id"), own.alias("vector"))
    usable = finite("vector") & F.exists("vector", lambda x: x != 0)
    points = materialise(
        base.where(usable).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "vectors"
    )
    links = None
    for row in points.select(F.size("vector").alias("dims")).distinct().collect():  # mostly one
        found = _links(points.where(F.size("vector") == row["dims"]), row["dims"], threshold, tile)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return base.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    links = materialise(links, "vector_links")
    number = links.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "rep")
    groups = components(links.where(F.col("a") != F.col("b"))).withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep", "vec_id")  # a vector without links is its own, with its copies
    return (
        base.join(points, "vector", "left")
        .drop("vector")
        .join(number, "rep", "left")
        .join(groups, "rep", "left")
        .select(
            "vec_id",
            F.coalesce(F.coalesce("n", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
            component.alias("component_id"),
            F.col("vec_id").eqNullSafe(component).alias("kept"),
        )
    )
