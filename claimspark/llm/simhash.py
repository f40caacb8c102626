"""Near-duplicate texts by SimHash, linked through vantage-point trees.

Two fingerprints that differ in at most ``max_bits`` bits differ in at most
``max_bits // BLOCKS`` bits of one of ``BLOCKS`` blocks of bits. So there is a
vantage-point tree for each block: it splits fingerprints by the Hamming distance of
that block to a vantage point, and a search of the small radius that is left for one
block passes over more branches than one of the whole radius would. The upper part of
each tree, fitted to a bounded sample, deals fingerprints to shards: each is a member
of the shard in which it falls and a query in all others that its ball overlaps. In a
shard the tree goes on, down to leaves that are compared over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise
from claimspark.llm.batches import as_bytes, slices
from claimspark.llm.components import components
from claimspark.llm.spread import spanning
from claimspark.llm.vectors import first_by_hash

BLOCKS = 3
#: Fingerprints that the upper trees are fitted to, members that a shard should have, members of a leaf.
SAMPLE, SHARD, LEAF = 65_536, 16_384, 96
#: Words of a text that are hashed at a time.
PIECE = 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_OFFSETS = (np.arange(8) * 256).astype(np.int64)


def masks() -> list[int]:
    """The bits of each block."""
    bounds = [round(64 * n / BLOCKS) for n in range(BLOCKS + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(bounds, bounds[1:])]


def fingerprint(data: bytes, shingle: int) -> int:
    """SimHash of a text: a bit is 1 if it is set in over half of the shingles' hashes."""
    words = data.lower().split()  # ASCII letters, ASCII white space
    if not words:
        return 0
    counts, number = np.zeros((8, 8), np.int64), 0
    last = max(len(words) - shingle + 1, 1)
    for at in range(0, last, PIECE):
        some = words[at : min(at + PIECE, last) + shingle - 1]
        joined = b" ".join(some)
        ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        width = min(shingle, len(some))
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], 42)
            for a, b in zip(begins[: len(some) - width + 1].tolist(), ends[width - 1 :].tolist())
        ]
        parts = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + _OFFSETS
        counts += np.bincount(parts.ravel(), minlength=2048).reshape(8, 256) @ _BITS
        number += len(hashes)
    return int(np.packbits((2 * counts > number).ravel(), bitorder="little").view(np.uint64)[0])


def _row_keys() -> list[Column]:
    """What tells rows apart: two hashes of doc_id and text, never null."""
    key = F.col("doc_id").cast("long")
    return [F.xxhash64(key, "text").alias("row_a"), F.xxhash64("text", key).alias("row_b")]


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, row_a, row_b, fp): fingerprints of whole texts as signed longs; without words 0, null texts too."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(data, shingle) for data in as_bytes(batch.column("text"))], np.uint64)
            kept = [batch.column(name) for name in ("doc_id", "row_a", "row_b")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(found.view(np.int64))], names=["doc_id", "row_a", "row_b", "fp"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_row_keys())
    return rows.mapInArrow(work, "doc_id long, row_a long, row_b long, fp long")


class Tree:
    """A vantage-point tree over one block; ``route`` deals fingerprints to its leaves."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, least: int, seed: int) -> None:
        self.mask, self.nodes, self.leaves = np.uint64(mask), [], 0
        self._random = np.random.default_rng(seed)
        self.root = self._build(np.unique(sample & self.mask), depth, least)

    def _build(self, points: np.ndarray, depth: int, least: int) -> int:
        if depth and len(points) >= 2 * least:
            vantage = points[self._random.integers(len(points))]
            distances = np.bitwise_count(points ^ vantage)
            split = int(np.median(distances))
            near = distances <= split
            if near.any() and not near.all():
                place = len(self.nodes)
                self.nodes.append(None)
                below = self._build(points[near], depth - 1, least), self._build(points[~near], depth - 1, least)
                self.nodes[place] = (vantage, split, *below)
                return place
        self.leaves += 1
        return -self.leaves

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, places of points, whether each falls there or only its ball reaches there)."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, places, inside = todo.pop()
            if not len(places):
                continue
            if node < 0:
                yield -node - 1, places, inside
                continue
            vantage, split, near, far = self.nodes[node]
            distances = np.bitwise_count((points[places] & self.mask) ^ vantage).astype(np.int16)
            reach = distances - radius <= split
            todo.append((near, places[reach], (inside & (distances <= split))[reach]))
            reach = distances + radius > split
            todo.append((far, places[reach], (inside & (distances > split))[reach]))


def _in_leaves(tree: Tree, members: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each leaf its members, and the queries whose ball reaches it."""
    mine = {leaf: places for leaf, places, _ in tree.route(members, 0)}
    for leaf, places, _ in tree.route(queries, radius):
        if leaf in mine:
            yield members[mine[leaf]], queries[places]


def _depth(number: int) -> int:
    return max(0, int(np.ceil(np.log2(max(number, 1) / LEAF))) + 4)


def _local_links(members: np.ndarray, queries: np.ndarray, mask: int, radius: int, max_bits: int) -> np.ndarray:
    """Links that join what is near each other in a shard: one or two for each fingerprint of a leaf.

    Many fingerprints that agree in the block cannot be parted by it: such a leaf goes on as a
    tree over the other bits, searched with the whole radius.
    """
    found = []
    for own, asked in _in_leaves(Tree(members, mask, _depth(len(members)), LEAF // 2, 1), members, queries, radius):
        leaves = [(own, asked)]
        if len(own) > 8 * LEAF:
            rest = Tree(own, ~mask & (1 << 64) - 1, _depth(len(own)), LEAF // 2, 2)
            leaves = _in_leaves(rest, own, asked, max_bits)
        for held, others in leaves:
            for at in range(0, len(held), 2048):
                for low in range(0, len(others), 2048):
                    some, more = held[at : at + 2048], others[low : low + 2048]
                    near = np.bitwise_count(some[:, None] ^ more[None, :]) <= max_bits
                    found.append(spanning(near, some, more))
    return np.concatenate(found) if found else np.zeros((0, 2), np.uint64)


def links(distinct: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b) between fingerprints (fp, distinct) such that those within ``max_bits`` of each other are joined.

    Not all pairs are listed: in a leaf, the members of a cluster are linked to its
    smallest, so a cluster of n gives some n links and not n squared.

    The upper trees have as many leaves as shards of some ``SHARD`` members need, at most
    what the sample can fit (2,048 for each block); beyond some 33 million distinct
    fingerprints shards grow with the data, unless ``SAMPLE`` does; those that grow beyond
    twice ``SHARD`` are searched in parts.
    """
    radius = max_bits // BLOCKS
    total = distinct.count()
    # a sample by the order of a hash: a bounded number of rows, whatever the table's size
    drawn = first_by_hash(distinct, ["fp"], total, SAMPLE)
    sample = np.array([row["fp"] for row in drawn.collect()], np.int64).view(np.uint64)
    depth = int(np.ceil(np.log2(max(total, 1) / SHARD))) if total > SHARD else 0
    trees = [Tree(sample, mask, depth, 16, seed) for seed, mask in enumerate(masks())]
    first = np.concatenate(([0], np.cumsum([tree.leaves for tree in trees])))

    def routed(batches) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, fingerprints, whether each is a member): for each batch and shard."""
        for batch in batches:
            points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for number, tree in enumerate(trees):
                for leaf, places, inside in tree.route(points, radius):
                    yield int(first[number] + leaf), points[places], inside

    def count(batches) -> Iterator[pa.RecordBatch]:
        held = np.zeros(int(first[-1]), np.int64)
        for shard, _, inside in routed(batches):
            held[shard] += inside.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held))), pa.array(held)], names=["shard", "members"])

    # a shard that a hot value of the block fills is dealt to several parts, and its queries to all of them
    sums = distinct.select("fp").mapInArrow(count, "shard long, members long").groupBy("shard").agg(F.sum("members").alias("members"))
    parts = np.ones(int(first[-1]), np.int64)
    for row in sums.collect():  # a row for each shard
        parts[row["shard"]] = max(1, -(-row["members"] // (2 * SHARD)))

    def deal(batches) -> Iterator[pa.RecordBatch]:
        for shard, points, inside in routed(batches):
            number = int(parts[shard])
            home = (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % number
            for part in range(number):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(points), shard)), pa.array(np.full(len(points), part)), pa.array(points.view(np.int64)), pa.array(inside & (home == part))],
                    names=["shard", "part", "fp", "inside"],
                )

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        tree = trees[int(np.searchsorted(first, frame["shard"].iloc[0], side="right")) - 1]
        queries = frame["fp"].to_numpy().view(np.uint64)
        found = _local_links(queries[frame["inside"].to_numpy(bool)], queries, int(tree.mask), radius, max_bits)
        return pd.DataFrame({"a": found[:, 0].copy().view(np.int64), "b": found[:, 1].copy().view(np.int64)}).drop_duplicates()

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, part long, fp long, inside boolean")
    return dealt.repartition(int(parts.sum()), "shard", "part").groupBy("shard", "part").applyInPandas(search, "a long, b long")


def _grouped(docs: DataFrame, shingle: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and (fp, component) of the distinct ones."""
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    points = materialise(own.select("fp").distinct(), "points")
    found = components(links(points, max_bits))
    group = points.join(found, points["fp"] == found["node"], "left")
    return own, group.select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text).

    Fingerprints link where they differ in ``max_bits`` bits or fewer; component_id
    is the smallest doc_id that links reach. Equal fingerprints are one point of the
    trees, so copies cost nothing there. Texts without words, null ones among them,
    have fingerprint zero and link like any other. A very long text is hashed a piece of
    its words at a time. Repeated rows each get a row. A null doc_id is larger than any
    other: a component_id is null only where no doc_id is reached. Columns other than
    doc_id and text, whatever their names, are left out; an empty table gives an empty
    result.
    """
    own, group = _grouped(docs, shingle, max_bits)
    # least doc_id of each fingerprint, then of each component: few rows meet in the second
    points = own.groupBy("fp").agg(F.min("doc_id").alias("least")).join(group, "fp")
    smallest = points.groupBy("component").agg(F.min("least").alias("component_id"))
    named = points.join(smallest, "component").select("fp", "component_id")
    return own.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` (doc_id, text and any columns) with one row of each component: that of the smallest doc_id.

    A null doc_id is the largest. Of different texts with that doc_id the one with the
    smaller hash stays, of rows that differ in other columns only the one with the smaller
    hash of all columns, and one of equal rows. Null and empty texts are one component;
    very long texts and empty tables are as in ``near_duplicates``.
    """
    own, group = _grouped(docs, shingle, max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_a", "row_b")
    points = own.groupBy("fp").agg(F.min(order).alias("first")).join(group, "fp")
    first = points.groupBy("component").agg(F.min("first").alias("first")).select("first.row_a", "first.row_b")
    whole = F.struct(*[F.col(f"`{name}`") for name in docs.columns]).alias("doc")
    values = [F.col(f"`{f.name}`").cast("string") if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    rows = docs.select(whole, *_row_keys(), F.xxhash64(*values).alias("row_c"))
    kept = rows.join(first, ["row_a", "row_b"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("row_a", "row_b").orderBy("row_c"))
    return kept.withColumn("row_rank", rank).where("row_rank = 1").select("doc.*")
