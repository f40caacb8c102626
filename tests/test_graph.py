"""Rings, cores and similar texts against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.operators import graph
from claimspark.operators.graph import (
    _candidates,
    core_numbers,
    grams,
    propagated,
    provider_cores,
    referral_rings,
    similar_addresses,
    similar_texts,
    strong_components,
)

YEAR = ("2025-01-01", "2025-12-31")


def plain_components(edges):
    """{node: smallest node on a cycle with it}, by reach from every node."""
    after = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            after.setdefault(a, set()).add(b)
            after.setdefault(b, set())
    reach = {}
    for node in after:
        seen, todo = set(), [node]
        while todo:
            for other in after[todo.pop()] - seen:
                seen.add(other)
                todo.append(other)
        reach[node] = seen
    return {n: min(m for m in reach[n] if n in reach[m]) for n in after if n in reach[n]}


def plain_cores(edges):
    """{node: core} by taking off the node with fewest neighbours again and again."""
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    cores, level = {}, 0
    while near:
        node = min(near, key=lambda n: len(near[n]))
        level = max(level, len(near[node]))
        cores[node] = level
        for other in near.pop(node):
            near[other].discard(node)
    return cores


@pytest.mark.parametrize("seed", [1, 2])
def test_rings_against_reach(spark, seed):
    rng = random.Random(seed)
    edges = [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("c4", "t0")] + [(f"t{i}", f"t{i + 1}") for i in range(8)]
    edges += [(f"r{rng.randint(0, 40)}", f"r{rng.randint(0, 40)}") for _ in range(45)]
    edges += [("x", "y"), ("y", "x"), ("x", "x"), ("s", "s"), ("r1", "c0"), (None, "x"), ("x", None), ("x", "y")]
    edges += [("hub", f"spoke{i}") for i in range(200)] + [("spoke7", "hub"), ("spoke8", "hub")]
    found = strong_components(spark.createDataFrame(edges, "source string, target string"), "source", "target")
    assert {r.node: r.component for r in found.collect()} == plain_components(edges)


def test_no_rings(spark):
    for rows in ([], [("a", "b"), ("b", "c"), ("a", "c"), ("d", "d")]):
        assert strong_components(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect() == []


def test_rings_of_referrals(build):
    claims = [{"referring_npi": a, "provider_npi": b} for a, b in ("AB", "BC", "CA", "CA", "CD", "DD", "EF", "FE", "GA")]
    claims.append({"referring_npi": "D", "provider_npi": "C", "service_date": "2024-12-31"})
    tables = build(claims=claims)
    found = {tuple(r) for r in referral_rings(tables, *YEAR).collect()}
    assert found == {(n, "A", 3, 4) for n in "ABC"} | {("E", "E", 2, 2), ("F", "E", 2, 2)}
    assert {r.ring for r in referral_rings(tables, *YEAR, min_size=3).collect()} == {"A"}
    assert referral_rings(tables, *YEAR, min_referrals=2).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_cores_against_peeling(spark, seed):
    rng = random.Random(seed)
    edges = [(f"k{a}", f"k{b}") for a in range(8) for b in range(a)]  # all linked to all
    edges += [("hub", f"leaf{i}") for i in range(300)] + [("hub", f"k{i}") for i in range(3)]  # a hot node of core 3
    edges += [(f"p{i}", f"p{i + 1}") for i in range(30)] + [("k0", "p0"), ("k0", "k0"), (None, "k1"), ("k1", "k0"), ("k0", "k1")]
    edges += [(f"r{rng.randint(0, 60)}", f"r{rng.randint(0, 60)}") for _ in range(200)]
    found = {r.node: (r.degree, r.core) for r in core_numbers(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    plain = plain_cores(edges)
    assert {n: c for n, (_, c) in found.items()} == plain
    assert found["hub"] == (303, 3) and found["k7"][1] == 7
    assert core_numbers(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_dense_groups_stay_apart(build):
    """Two groups of three and a provider between them: with a link to each it joins them, with one it is outside."""
    claims = []
    for n, group in enumerate(["ABC", "DEF", "CX", "XD"]):
        for member in range(3):
            claims += [{"member_id": f"M{n}{member}", "provider_npi": p} for p in group]
    found = {r.provider_npi: (r.partners, r.core, r.dense_group) for r in provider_cores(build(claims=claims), *YEAR).collect()}
    assert found["A"] == (2, 2, "A") and found["F"] == (2, 2, "A") and found["X"] == (2, 2, "A")
    apart = {r.provider_npi: r.dense_group for r in provider_cores(build(claims=claims[:-6]), *YEAR).collect()}
    assert apart == {"A": "A", "B": "A", "C": "A", "D": "D", "E": "D", "F": "D", "X": None}


def plain_similar(texts, threshold, q=3):
    def grams(text):
        padded = "\x02" * (q - 1) + text + "\x03" * (q - 1)
        return {padded[i : i + q] for i in range(len(text) + q - 1)}

    own = sorted({t for t in texts if t})
    out = set()
    for n, a in enumerate(own):
        for b in own[n + 1 :]:
            x, y = grams(a), grams(b)
            similarity = len(x & y) / len(x | y)
            if similarity >= threshold - 1e-12:
                out.add((a, b, round(similarity, 9)))
    return out


@pytest.mark.parametrize("threshold, q", [(0.3, 2), (0.6, 3), (0.8, 3), (1.0, 1), (0.5, 4)])
def test_similar_texts_against_all_pairs(spark, threshold, q):
    rng = random.Random(q)
    texts = ["12 main street suite 4", "12 main st ste 4", "12 main street ste 4", "", None, "a", "ab", "aaaa", "aaaaa", "naïve", "naive", "日本", "日本橋"]
    for _ in range(120):
        text = list(rng.choice(["100 north main street ", "suite ", "po box ", "77 oak avenue floor "]) + str(rng.randint(1, 60)))
        for _ in range(rng.randint(0, 2)):
            text[rng.randrange(len(text))] = rng.choice("abc ")
        texts.append("".join(text))
    rows = spark.createDataFrame([(t,) for t in texts * 2], "text string")
    found = {(r.text_a, r.text_b, round(r.similarity, 9)) for r in similar_texts(rows, threshold, q).collect()}
    assert found == plain_similar(texts, threshold, q)


def test_similar_texts_join_on_rare_grams_only(spark):
    """Texts that share frequent grams alone never meet."""
    rows = spark.createDataFrame([(f"common beginning of all {n * 7919:09d}",) for n in range(300)], "text string")
    plan = similar_texts(rows, 0.9)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert similar_texts(rows, 0.9).count() == len(plain_similar([r.text for r in rows.collect()], 0.9))


def test_candidates_of_one_host_are_few(spark):
    """Addresses of one host share most grams; few of the pairs that share a rare one are verified, and none is lost."""
    ends = ["", "/", ".html", "#top", "?utm_source=feed"]
    texts = [f"https://one.example.net/en/{n * 7919 % 100_000}{ends[n % 5]}" for n in range(400)]
    sets = spark.createDataFrame([(t,) for t in texts], "text string").select("text", grams(F.col("text"), 3).alias("grams"))
    candidates = {(r.text_a, r.text_b) for r in _candidates(sets, 0.8).collect()}
    wanted = {(a, b) for a, b, _ in plain_similar(texts, 0.8)}
    assert wanted <= candidates
    assert len(candidates) < 3 * len(wanted)


def test_similar_addresses(build):
    place = lambda npi, city, state="TX", zip_="75001": {"npi": npi, "practice_city": city, "practice_state": state, "practice_zip": zip_}
    tables = build(providers=[place("1", "Main St. 12, Suite 4"), place("2", "main st 12 - suite 4"), place("3", "Main St 12 Ste 4"), place("4", "Elsewhere"), place("5", None)])
    found = [tuple(r) for r in similar_addresses(tables, 0.6).collect()]
    assert [(a, b, x, y) for a, b, _, x, y in found] == [("main st 12 ste 4 tx 75001", "main st 12 suite 4 tx 75001", 1, 2)]
    with pytest.raises(ValueError, match="threshold"):
        similar_addresses(tables, 0)


def test_propagated_values_against_a_plain_solution(spark):
    rng = random.Random(3)
    edges = [("hub", f"n{i}", 1 + i % 3) for i in range(40)] + [(f"n{i}", "hub", 2) for i in range(30)] + [("n1", "n2", 5), ("n1", "n2", 1), ("n3", "n3", 9), (None, "n1", 1)]
    values = [(f"n{i}", rng.random()) for i in range(45)] + [(None, 1.0)]
    found, residual = propagated(spark.createDataFrame(values, "node string, value double"), spark.createDataFrame(edges, "a string, b string, weight long"), damping=0.7)
    own = {n: v for n, v in values if n}
    nodes = sorted(set(own) | {n for a, b, _ in edges if a and a != b for n in (a, b)})
    place = {n: i for i, n in enumerate(nodes)}
    matrix = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        if a and a != b:
            matrix[place[a], place[b]] += w
    totals = matrix.sum(1, keepdims=True)
    shares = np.divide(matrix, totals, out=np.zeros_like(matrix), where=totals > 0)
    start = np.array([own.get(n, 0.0) for n in nodes])
    alone = totals[:, 0] == 0
    system = np.eye(len(nodes)) - 0.7 * shares
    want = np.linalg.solve(system, np.where(alone, start, 0.3 * start))
    assert residual <= 1e-9
    for r in found.collect():
        assert abs(r.spread - want[place[r.node]]) < 1e-8 and r.own == own.get(r.node, 0.0)
    with pytest.raises(ValueError):
        propagated(found, found, damping=1.0)


def test_network_risk_makes_the_claims_once(build, spark, monkeypatch):
    """Referrals and shared patients read the same written claims."""
    day = lambda p, m, r=None, d="2025-02-03": {"provider_npi": p, "member_id": m, "referring_npi": r, "service_date": d}
    rows = [day(p, f"M{n}") for p in ("P1", "P2") for n in range(3)] + [day("P3", "M9", "P1"), day("P2", "M9", "P4", "2024-12-31")]
    read = []
    for name in ("referral_edges", "shared_patient_edges"):
        run = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda tables, *a, run=run, **o: (read.append(tables["claims"]), run(tables, *a, **o))[1])
    risk = spark.createDataFrame([("P1", 0.8), ("P2", 0.0)], "provider_npi string, composite_risk_score double")
    found = {r.provider_npi: r.network_risk for r in graph.network_risk(build(claims=rows), risk, *YEAR).collect()}
    # P1 hears 3 of 4 from P2 and 1 of 4 from P3; P2 hears P1 alone, and so does P3
    p1 = 0.4 / (1 - 0.5 * 0.5)
    assert found == pytest.approx({"P1": p1, "P2": 0.5 * p1, "P3": 0.5 * p1}, abs=1e-6)
    assert len(read) == 2 and all(c.inputFiles() and all("network_claims" in f for f in c.inputFiles()) for c in read)
