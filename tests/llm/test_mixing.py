"""The mixture's weights, budgets and blocks."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest

from claimspark.llm import mixing


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    sizes = {"big": 400, "middle": 100, "small": 12, None: 30}
    rows = [(s, " ".join("w" * rng.randint(1, 9) for _ in range(rng.randint(0, 60)))) for s, n in sizes.items() for _ in range(n)]
    return spark.createDataFrame([(i, t, s, 7) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string, mix_rows int")


def held(rows):
    total = Counter()
    for r in rows:
        total[r["source"]] += r["tokens"]
    return total


def test_repetition_limit(docs):
    own = {r["source"]: r["tokens"] for r in mixing.source_tokens(mixing.with_row(docs)).collect()}
    for limit in (1.0, 2.0, 3.5):
        rows = mixing.schedule(docs, repetition=limit, block_tokens=500).collect()
        assert {r["doc_id"] for r in rows} == set(range(542))  # every document occurs
        times = {s: n / own[s] for s, n in held(rows).items()}
        assert times["big"] == pytest.approx(1, abs=0.02)
        assert times["small"] == pytest.approx(limit, abs=80 / own["small"])
        counts = Counter(r["doc_id"] for r in rows)
        assert max(counts.values()) <= math.ceil(limit)


def test_entropy_target(docs):
    for target in (0.9, 1.2):
        rows = mixing.schedule(docs, entropy=target).collect()
        own = held(rows)
        share = [n / sum(own.values()) for n in own.values()]
        assert -sum(p * math.log(p) for p in share) == pytest.approx(target, abs=0.02)


def test_budget_and_blocks(docs):
    rows = mixing.schedule(docs, total_tokens=6000, block_tokens=1000).collect()
    own = held(rows)
    assert sum(own.values()) == pytest.approx(6000, abs=4 * 61)
    blocks = defaultdict(Counter)
    for r in rows:
        blocks[r["block"]][r["source"]] += r["tokens"]
    assert sorted(blocks) == list(range(6))
    for block in blocks.values():  # each block has each source's share, but for a document at either edge
        for source, total in own.items():
            assert abs(block[source] - total / 6) <= 2 * 61
    places = defaultdict(list)
    for r in rows:
        places[r["source"]].append((r["start"], r["tokens"]))
    for parts in places.values():  # documents follow each other without gaps
        at = 0
        for start, tokens in sorted(parts):
            assert start == at
            at += tokens


def test_buckets_do_not_change_the_order(docs, monkeypatch):
    plain = sorted(map(tuple, mixing.schedule(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(map(tuple, mixing.schedule(docs).collect()), key=str) == plain


def test_mixed_documents(docs):
    planned = Counter(r["doc_id"] for r in mixing.schedule(docs, repetition=3).collect())
    mixed = mixing.mix(docs, repetition=3)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == planned


def test_mixed_rows_are_those_of_the_plan(spark):
    """Equal rows, rows that differ in another column only, and one row that holds a third of the table."""
    rows = [(1, "a b c", "s", 1), (1, "a b c", "s", 1), (1, "a b c", "s", 2), (2, "d " * 40, "s", 1), (None, None, None, None)]
    rows += [(9, "x y", "t", 0)] * 40 + [(n, "w " * (n % 7), "u", n) for n in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int").repartition(4)
    for options in ({"total_tokens": 170}, {"total_tokens": 1000}, {"repetition": 3.0}):
        planned = mixing.schedule(docs, **options)
        found = mixing.mix(docs, **options)
        assert found.count() == planned.count()
        assert Counter(r["doc_id"] for r in found.collect()) == Counter(r["doc_id"] for r in planned.collect())
        assert {tuple(r) for r in found.collect()} <= set(rows)


def test_mixed_rows_come_in_blocks(docs):
    place = {}
    for r in mixing.schedule(docs, repetition=1.0, block_tokens=500).collect():
        place.setdefault(r["doc_id"], []).append((r["block"], r["start"]))
    blocks = [place[r["doc_id"]][0] for r in mixing.mix(docs, repetition=1.0, block_tokens=500).collect()]
    ends = [n for n in range(1, len(blocks)) if blocks[n][0] != blocks[n - 1][0]]
    assert len(ends) + 1 == len({b for b, _ in blocks}) > 5  # each block's rows are together
    for a, b in zip([0, *ends], [*ends, len(blocks)]):
        assert [start for _, start in blocks[a:b]] == sorted(start for _, start in blocks[a:b])


def test_impossible_limits(docs):
    with pytest.raises(ValueError):
        mixing.schedule(docs, repetition=0.5)
