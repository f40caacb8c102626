"""Shards by fixed virtual slots and a versioned map from slots to shards."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.functions.scratch import materialise, scratch_path

SLOTS = 4096

MAP = "virtual_slot int, bytes long, rows long, shard int"


def slotted(docs: DataFrame, slots: int = SLOTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the virtual slot: a hash of the key, of key and text where rows share a key.

    A row whose key is null hashes its text alone, so that rows without a key do not
    share a slot. Size is the text's UTF-8 bytes plus 1.
    """
    place = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.crc32(F.coalesce(F.col(text), F.lit(""))))
    return docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        F.pmod(place, F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most as many rows as there are slots."""
    sizes = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    return [(r["virtual_slot"], r["bytes"], r["rows"]) for r in sizes.collect()]


def assign(sizes: list[tuple[int, int, int]], shards: int) -> dict[int, int]:
    """Slot to shard: the largest slot that is left goes to the lightest shard."""
    heap = [(0, shard) for shard in range(shards)]
    chosen = {}
    for slot, size, _ in sorted(sizes, key=lambda s: (-s[1], s[0])):
        held, shard = heapq.heappop(heap)
        chosen[slot] = shard
        heapq.heappush(heap, (held + size, shard))
    return chosen


def rebalance(sizes: list[tuple[int, int, int]], current: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards: slots move from shards above the mean to the lightest, and no others.

    New shards fill up from all old ones, so what moves is about the share of the new
    shards. Slots that the map does not know yet go to the lightest shard. Shards
    beyond ``shards`` are emptied.
    """
    size = {slot: held for slot, held, _ in sizes}
    target = sum(size.values()) / shards
    edited = {slot: shard for slot, shard in current.items() if shard < shards}
    held = [0] * shards
    for slot, shard in edited.items():
        held[shard] += size.get(slot, 0)
    moving = [slot for slot in size if slot not in edited]
    own: dict[int, list[int]] = {}
    for slot in edited:
        own.setdefault(edited[slot], []).append(slot)
    for shard, slots in own.items():
        for slot in sorted(slots, key=lambda s: (-size.get(s, 0), s)):
            if size.get(slot, 0) and held[shard] - size[slot] >= target:
                held[shard] -= size[slot]
                moving.append(slot)
    for slot in sorted(moving, key=lambda s: (-size[s], s)):
        lightest = min(range(shards), key=lambda k: (held[k], k))
        edited[slot] = lightest
        held[lightest] += size[slot]
    for _ in range(len(edited)):  # what is left of the difference, slot by slot
        heavy, light = (pick(range(shards), key=lambda k: (held[k], k)) for pick in (max, min))
        if held[heavy] - held[light] <= max(size.values(), default=0):
            break
        able = [s for s, shard in edited.items() if shard == heavy and size.get(s, 0)]
        slot = min(able, key=lambda s: (abs(2 * size[s] - held[heavy] + held[light]), s))
        edited[slot] = light
        held[heavy] -= size[slot]
        held[light] += size[slot]
    return edited


def store_map(spark: SparkSession, path: str, version: int, chosen: dict[int, int], sizes: list[tuple[int, int, int]]) -> DataFrame:
    """Write a version of the map under ``path`` and return it; versions stay as they were written."""
    known = {slot: (held, rows) for slot, held, rows in sizes}
    rows = [(slot, *known.get(slot, (0, 0)), shard) for slot, shard in sorted(chosen.items())]
    target = f"{path}/version={version}"
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(target)
    return spark.read.schema(MAP).parquet(target)


def load_map(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """A stored version: at most as many entries as there are slots."""
    return {r["virtual_slot"]: r["shard"] for r in spark.read.schema(MAP).parquet(f"{path}/version={version}").collect()}


def shard(docs: DataFrame, shards: int = 16, slots: int = SLOTS, path: str | None = None, version: int = 1) -> DataFrame:
    """Each row of ``docs`` (doc_id, text) with its shard, by size: ``law`` is ``bytes``.

    Rows are hashed to ``slots`` virtual slots, bytes are summed for each slot, and
    slots are dealt to shards so that these hold nearly equal bytes. The map is
    written under ``path`` (a scratch folder if none is given) as ``version``.

    Returns doc_id, size, text_crc32, law, shard, slot (the row's place in its shard,
    from 0 without gaps), grown_shard (null: the law is not ``key``) and virtual_slot.
    A null text has size 1 and the checksum of the empty text; a long text counts all its
    bytes. Equal rows share a virtual slot and get places of their own, in any order among
    them: shards are as even as slots allow, and a row that repeats so often that its slot
    outweighs a shard's share makes that shard heavier. Other columns, whatever their names,
    are left out; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = materialise(slotted(docs, slots), "slotted")
    sizes = slot_sizes(rows)
    chosen = store_map(spark, path or scratch_path(spark, "slots"), version, assign(sizes, shards), sizes)
    # places: those of the slots before it in the shard, then the place in the slot
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    first = chosen.select("virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("place", F.row_number().over(own))
        .join(F.broadcast(first), "virtual_slot")  # at most `slots` rows
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("first") + F.col("place") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
        )
    )
