"""Repeated passages across documents, by windows of words that double in length.

Short windows that occur in one document only cannot be part of a longer one that
occurs in two. So windows are judged at a short length first, only those that repeat are
extended to (at most) twice that length, and so on up to the length asked for, or until
none is left. Below that length it is enough to judge some windows: of each run of
neighbours that fills the next length, the one with the least hash. Equal texts choose
alike, and every longer window holds one that was judged.

Judging is one shuffle by the hash of the window. Before it, each batch of documents is
judged on its own, and sends on at most one document, or two, for each window: so a
passage that is in very many documents arrives as often as there are batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.batches import as_bytes, slices
from claimspark.llm.words import least_in_zone, selected, windows, word_hashes

#: Lengths are halved until they are no longer than this.
SHORTEST = 8
LAST = (1 << 63) - 1
#: Rows and bytes of text that are judged together before the shuffle.
JUDGED = (4096, 16 << 20)

_SEED = "place long, ord long, tag long, pos int, kind int"
_WINDOW = "place long, ord long, tag long, pos int, size int, kind int, hashes array<long>"
_JUDGE, _KNOWN, _SHOWN = 0, 1, 2


def lengths(window: int) -> list[int]:
    """The lengths at which windows are judged: each at most twice the one before."""
    found = [window]
    while found[0] > SHORTEST:
        found.insert(0, -(-found[0] // 2))
    return found


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, and what tells rows apart: ord (doc_id, a null after all others) and a hash of the text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("ord"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"),
    )


def _copies(rows: DataFrame) -> DataFrame:
    """(ord, tag, copied) of rows whose whole text is that of a smaller doc_id."""
    digests = rows.select("ord", "tag", F.xxhash64(F.lit(1), F.coalesce("text", F.lit(""))).alias("check"))
    first = digests.groupBy("tag", "check").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    first = first.where("first < last")
    return digests.join(first, ["tag", "check"]).where("ord > first").select("ord", "tag").distinct().withColumn("copied", F.lit(True))


def _spread(ords: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Keys that deal out rows that need not meet."""
    return ((ords + places) * np.int64(0x5851F42D4C957F2D)) ^ ords


def _batch(batch: pa.RecordBatch, previous: int, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, windows' hashes, whether each is to be judged, what equal windows share, and its place).

    A window is judged if the least of the shorter windows in it, which equal windows
    have in common, repeated at the length before; its hash is what they share.
    """
    held = batch.column("held") if previous else None
    for row, data in enumerate(as_bytes(batch.column("text"))):
        hashes = word_hashes(data.split())
        found = windows(hashes, length)
        if not len(found):
            continue
        if held is None:
            yield row, found, np.ones(len(found), bool), found, np.arange(len(found))
            continue
        shorter = windows(hashes, previous)
        least = least_in_zone(shorter, length - previous + 1)
        repeated = np.zeros(len(shorter), bool)
        repeated[held[row].values.to_numpy()] = True
        yield row, found, repeated[least], shorter[least], least


def _repeated(rows: DataFrame, previous: int, length: int, zone: int) -> DataFrame:
    """(ord, tag, held): places, each once however often the row repeats, of the judged windows of ``length`` words that occur under more than one doc_id."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", *JUDGED):
            ords, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "tag"))
            parts = []
            for row, found, allowed, _, _ in _batch(batch, previous, length):
                chosen = selected(found, zone)
                chosen = chosen[allowed[chosen]]
                parts.append((found[chosen], np.full(len(chosen), row), chosen))
            if not parts:
                continue
            hashes, row, pos = (np.concatenate(p) for p in zip(*parts))
            order = np.lexsort((ords[row], hashes))
            hashes, row, pos = hashes[order].view(np.int64), row[order], pos[order]
            begin = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]][: len(hashes)])
            if not len(begin):
                continue
            end = np.append(begin[1:], len(hashes)) - 1
            own = ords[row]
            known = np.repeat(own[begin] != own[end], end - begin + 1)
            shown = np.concatenate([begin[known[begin]], end[known[begin]]])
            place = np.concatenate([np.where(known, _spread(own, pos), hashes), hashes[shown]])
            taken = np.concatenate([np.arange(len(hashes)), shown])
            kind = np.concatenate([np.where(known, _KNOWN, _JUDGE), np.full(len(shown), _SHOWN)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(place), pa.array(own[taken]), pa.array(tags[row[taken]]),
                    pa.array(pos[taken].astype(np.int32)), pa.array(kind.astype(np.int32)),
                ],
                names=["place", "ord", "tag", "pos", "kind"],
            )

    group = Window.partitionBy("place")
    judged = rows.mapInArrow(work, _SEED).withColumns(
        {"low": F.min("ord").over(group), "high": F.max("ord").over(group)}
    )
    kept = judged.where((F.col("kind") == _KNOWN) | ((F.col("kind") == _JUDGE) & (F.col("low") < F.col("high"))))
    return kept.groupBy("ord", "tag").agg(F.collect_set("pos").alias("held"))


def _removed(rows: DataFrame, previous: int, window: int) -> DataFrame:
    """(ord, tag, runs): where windows begin that also begin in a document with a smaller doc_id, as (pos, size)."""

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", *JUDGED):
            ords, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("ord", "tag"))
            parts = []
            for row, found, allowed, shared, least in _batch(batch, previous, window):
                pos = np.flatnonzero(allowed)
                if len(pos):
                    parts.append((found[pos], np.full(len(pos), row), pos, least[pos], shared[pos]))
            if not parts:
                continue
            hashes, row, pos, least, place = (np.concatenate(p) for p in zip(*parts))
            # in the batch: all but those of the smallest doc_id are removed
            order = np.lexsort((ords[row], hashes, place))
            same = (hashes[order][1:] == hashes[order][:-1]) & (place[order][1:] == place[order][:-1])
            begin = np.flatnonzero(np.r_[True, ~same])
            smallest = np.repeat(ords[row[order]][begin], np.diff(np.append(begin, len(order))))
            gone = np.empty(len(order), bool)
            gone[order] = ords[row[order]] > smallest
            # runs of neighbours that are removed, or that share what they are sent with
            joins = (row[1:] == row[:-1]) & (pos[1:] == pos[:-1] + 1) & (gone[1:] == gone[:-1]) & (gone[1:] | (least[1:] == least[:-1]))
            begin = np.flatnonzero(np.r_[True, ~joins])
            size = np.diff(np.append(begin, len(pos)))
            kind = np.where(gone[begin], _KNOWN, _JUDGE)
            own = ords[row[begin]]
            key = np.where(kind == _KNOWN, _spread(own, pos[begin]), place[begin].view(np.int64))
            sent = np.where(kind == _KNOWN, 0, size)
            values = hashes[~gone].view(np.int64)  # in the order of the runs that send them
            offsets = np.concatenate(([0], np.cumsum(sent))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key), pa.array(own), pa.array(tags[row[begin]]), pa.array(pos[begin].astype(np.int32)),
                    pa.array(size.astype(np.int32)), pa.array(kind.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=["place", "ord", "tag", "pos", "size", "kind", "hashes"],
            )

    sent = rows.mapInArrow(work, _WINDOW).repartition("place")
    single = sent.select("place", "ord", "tag", "pos", "size", "kind", F.posexplode_outer("hashes").alias("step", "hash"))
    judged = single.withColumn("low", F.min("ord").over(Window.partitionBy("place", "hash")))
    gone = judged.where((F.col("kind") == _KNOWN) | (F.col("ord") > F.col("low")))
    begins = (F.col("pos") + F.coalesce("step", F.lit(0))).alias("pos")
    run = F.struct(begins, F.when(F.col("kind") == _KNOWN, F.col("size")).otherwise(1).alias("size"))
    return gone.groupBy("ord", "tag").agg(F.collect_set(run).alias("runs"))


def mark(docs: DataFrame, window: int = 13) -> DataFrame:
    """``doc_id, text, copied, runs`` for each row of ``docs`` (doc_id, text): what ``covered`` needs.

    ``copied`` rows have the whole text of a smaller doc_id; ``runs`` (pos, size) say where
    windows of ``window`` words begin that also begin in a document with a smaller doc_id.
    """
    rows = _rows(docs)
    copies = _copies(rows)
    key = ["ord", "tag"]
    live = rows.join(copies, key, "left").where(F.col("copied").isNull()).drop("copied")
    previous, held = 0, None
    steps = lengths(window)
    for length, longer in zip(steps, steps[1:]):
        held = _repeated(live if held is None else live.join(held, key), previous, length, longer - length + 1)
        previous = length
    removed = _removed(live if held is None else live.join(held, key), previous, window)
    return rows.join(copies, key, "left").join(removed, key, "left").select("doc_id", "text", "copied", "runs")


def covered(number: int, window: int, copied: bool, runs: pa.Array | None) -> np.ndarray:
    """Which of a document's words lie in a removed window."""
    if copied:
        return np.full(number, number >= window)
    edges = np.zeros(number + 1, np.int64)
    if runs is not None and len(runs):
        pos = runs.field("pos").to_numpy(zero_copy_only=False)
        size = runs.field("size").to_numpy(zero_copy_only=False)
        np.add.at(edges, pos, 1)
        np.add.at(edges, pos + size - 1 + window, -1)
    return np.cumsum(edges)[:number] > 0


def remove_repeated(docs: DataFrame, window: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) for each row of ``docs`` (doc_id, text).

    Words are what ASCII white space separates. Each word is removed that a window of
    ``window`` words covers whose words also begin in a document with a smaller doc_id;
    windows are judged on the texts as they came. The words that are left are joined by
    one space. A window is known by 128 bits of hash.

    A null or empty text has no words; a very long one is work of one row, in batches of its
    own, and so are its windows. A null doc_id is larger than any other, and rows
    that share a doc_id do not remove from each other, repeated rows neither. Other
    columns are left out; an empty table gives an empty result.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, gone, kept = [], [], []
            copied, runs = batch.column("copied").to_pylist(), batch.column("runs")
            for row, data in enumerate(as_bytes(batch.column("text"))):
                words = data.split()
                out = covered(len(words), window, bool(copied[row]), runs[row].values)
                counts.append(len(words))
                gone.append(int(out.sum()))
                kept.append(b" ".join(words if not gone[-1] else [w for w, o in zip(words, out.tolist()) if not o]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return mark(docs, window).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_text string")
