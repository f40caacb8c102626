"""Runs of words that repeat with a period inside one text, from its suffixes.

The suffixes of a text are sorted, and neighbours in that order are united by falling
length of what they share, as Kruskal's algorithm takes edges: union-find over classes that
keep their positions in order. Two positions that become neighbours in a class that shares
``l`` words, at a distance of at most ``l``, are the first two beginnings of a run with that
distance as its smallest period: a beginning between them would have been united earlier.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.batches import as_bytes, slices


def suffix_order(codes: np.ndarray, least: int) -> np.ndarray | None:
    """Positions in the order of the suffixes there; None if no two share ``least`` words.

    Doubling: suffixes are ranked by their first 1, 2, 4, ... words until all ranks differ.
    """
    number, width = len(codes), 1
    rank = codes.astype(np.int64)
    while True:
        after = np.zeros(number, np.int64)
        after[:-width] = rank[width:] + 1
        key = rank * (number + 1) + after
        order = key.argsort()
        ordered = key[order]
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        width *= 2
        if width >= number or rank[order[-1]] == number - 1:
            return order if width > least else None


def shared_words(codes: list[int], order: list[int]) -> np.ndarray:
    """How many words each suffix in ``order`` shares with the one before it."""
    number = len(codes)
    place = np.empty(number, np.int64)
    place[order] = np.arange(number)
    shared, same = [0] * number, 0
    for i, at in enumerate(place.tolist()):
        if not at:
            same = 0
            continue
        j = order[at - 1]
        end = number - max(i, j)
        while same < end and codes[i + same] == codes[j + same]:
            same += 1
        shared[at] = same
        same -= same > 0
    return np.array(shared, np.int64)


def neighbours(order: list[int], shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(i, j, l): positions that become neighbours in a class of suffixes that share l words, l falling to ``least``."""
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    above: dict[int, int] = {}
    positions: dict[int, list[int]] = {}

    def root(at: int) -> int:
        while above.setdefault(at, at) != at:
            above[at] = at = above[above[at]]
        return at

    for at, length in zip(edges.tolist(), shared[edges].tolist()):
        one, two = root(at - 1), root(at)
        large, small = (positions.pop(r, None) or [order[r]] for r in (one, two))
        if len(large) < len(small):
            large, small = small, large
        above[one] = two
        positions[two] = large
        last = None
        for n in range(len(small) - 1, -1, -1):
            position, lower = small[n], small[n - 1] if n else -1
            place = bisect_left(large, position)
            if place < len(large) and large[place] != last:
                yield position, large[place], length
            if place and large[place - 1] > lower:
                yield large[place - 1], position, length
            large.insert(place, position)
            last = position


def find_runs(words: list[bytes], least_words: int = 24, least_periods: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least that many words and periods, by start and period."""
    if least_periods < 2:
        raise ValueError("a run has at least two periods")
    if len(words) < max(least_words, least_periods):
        return []
    known: dict[bytes, int] = {}
    codes = [known.setdefault(word, len(known)) for word in words]
    # a run shares its length without one period with its second period
    least = max(least_words - least_words // least_periods, least_periods - 1)
    found = suffix_order(np.array(codes), least)
    if found is None:
        return []
    order = found.tolist()
    runs = []
    for i, j, same in neighbours(order, shared_words(codes, order), least):
        period = j - i
        if same < (least_periods - 1) * period or same + period < least_words:
            continue
        if not i or codes[i - 1] != codes[j - 1]:  # else it belongs to a run that begins before
            runs.append((i, same + period, period))
    return sorted(runs, key=lambda run: (run[0], run[2]))


def after_first_period(number: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of a text's words some run holds after its first period."""
    edges = np.zeros(number + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges)[:number] > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def collapse_runs(docs: DataFrame, least_words: int = 24, least_periods: int = 3) -> DataFrame:
    """(doc_id, n_words, n_dropped, runs, collapsed_text) for each row of ``docs`` (doc_id, text).

    Words are what ASCII white space parts, numbered from 0. ``runs`` (start, length, period)
    are the stretches, by start and period, whose words ``period`` apart are alike, of at
    least ``least_words`` words and ``least_periods`` of their smallest period, that no
    neighbouring word extends. The text keeps of each run its first period; words that are
    left are joined by one space.

    Each text is work of its own: its suffixes are sorted in time that grows a little faster
    than its words, whatever repeats in it, and only suffixes that share enough words for a
    run are united. A null or empty text has no words and no runs. Repeated rows have equal
    results, null doc_ids stay. Other columns are left out, whatever their names; an empty
    table gives an empty result.
    """

    def work(batches) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, dropped, kept, flat, ends = [], [], [], [], [0]
            for text in as_bytes(batch.column("text")):
                words = text.split()
                runs = find_runs(words, least_words, least_periods)
                counts.append(len(words))
                gone = after_first_period(len(words), runs) if runs else np.zeros(0, bool)
                dropped.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if runs else words))
                flat += runs
                ends.append(len(flat))
            parts = [pa.array([run[n] for run in flat], pa.int64()) for n in range(3)]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(dropped, pa.int64()), found, pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_dropped", "runs", "collapsed_text"],
            )

    schema = "doc_id long, n_words long, n_dropped long, runs array<struct<start:long,length:long,period:long>>, collapsed_text string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(work, schema)
