from __future__ import annotations

import random
from collections import defaultdict
from datetime import date, timedelta
from decimal import Decimal

import pytest

from claimspark.operators.network import (
    connected_components,
    provider_clusters,
    referral_concentration,
    referral_loops,
    referral_network,
    shared_identity,
    shared_identity_members,
    shared_patient_edges,
    shared_patients,
)
from claimspark.plans.findings import provider_scores
from claimspark.plans.registry import run

YEAR = ("2025-01-01", "2025-12-31")


def visit(npi, member, day):
    return {"provider_npi": npi, "member_id": member,
            "service_date": (date(2025, 1, 1) + timedelta(days=day)).isoformat()}


def brute_force(claims, min_shared, days=7, start=date(2025, 1, 1), end=date(2025, 12, 31)):
    shared, pairs = defaultdict(set), defaultdict(int)
    for a in claims:
        if not start <= date.fromisoformat(a["service_date"]) <= end:
            continue
        for b in claims:
            gap = abs((date.fromisoformat(a["service_date"]) - date.fromisoformat(b["service_date"])).days)
            if a["member_id"] == b["member_id"] and a["provider_npi"] != b["provider_npi"] and gap <= days:
                key = (a["provider_npi"], b["provider_npi"])
                shared[key].add(a["member_id"])
                pairs[key] += 1
    return sorted((*k, len(m), pairs[k]) for k, m in shared.items() if len(m) >= min_shared)


def test_shared_patients_band(build, rows):
    claims = [visit("A", f"M{i}", 10) for i in range(3)] + [visit("B", f"M{i}", 17 + (i == 2)) for i in range(3)]
    tables = build(claims=claims)
    assert rows(shared_patients(tables, *YEAR)) == []
    assert rows(shared_patients(tables, *YEAR, min_shared=2)) == [("A", "B", 2, 2), ("B", "A", 2, 2)]


def test_shared_patients_looks_outside_the_period_for_the_other(build, rows):
    claims = [visit("A", "M", 1), visit("B", "M", -5)]
    assert rows(shared_patients(build(claims=claims), *YEAR, min_shared=1)) == [("A", "B", 1, 1)]


@pytest.mark.parametrize("min_shared", [1, 2, 3])
def test_shared_patients_equals_brute_force_with_busy_members(build, rows, min_shared):
    random.seed(min_shared)
    providers = [f"P{i}" for i in range(12)]
    claims = []
    for p in providers:  # two members that everybody sees, often
        claims += [visit(p, "everyone", random.randint(-10, 40)) for _ in range(6)]
        if random.random() < 0.7:
            claims += [visit(p, "most", random.randint(0, 40)) for _ in range(4)]
    for _ in range(120):
        claims.append(visit(random.choice(providers), f"M{random.randint(0, 12)}", random.randint(-10, 60)))
    claims += [visit("P1", None, 3), visit(None, "M1", 3)]
    kept = [c for c in claims if c["member_id"] and c["provider_npi"]]
    tables = build(claims=claims)
    expected = brute_force(kept, min_shared)
    assert expected
    assert rows(shared_patient_edges(tables, *YEAR, min_shared=min_shared)) == expected
    one = rows(shared_patient_edges(tables, *YEAR, ["P3"], min_shared=min_shared))
    assert one == [r for r in expected if r[0] == "P3"]


def test_busy_members_do_not_form_pairs_alone(build, rows):
    claims = [visit(f"P{i}", m, 5) for i in range(30) for m in ("H1", "H2")]
    assert rows(shared_patient_edges(build(claims=claims), *YEAR)) == []


def test_top_partners_with_ties(build, rows):
    claims = [visit(n, "M", 5) for n in "ABCDE"]
    found = rows(shared_patients(build(claims=claims), *YEAR, "A", min_shared=1, top=2), "other_provider")
    assert found == [("B",), ("C",)]


def test_components_of_chains_and_stars(spark, rows):
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)]
    star = [("s0", f"s{i}") for i in range(1, 40)]
    edges = spark.createDataFrame(chain + star + [("x", "y"), ("y", "x"), ("z", "z"), ("q", None)], "a string, b string")
    found = dict(rows(connected_components(edges, "a", "b")))
    assert {found[n] for pair in chain for n in pair} == {"n000"}
    assert {found[n] for pair in star for n in pair} == {"s0"}
    assert found["y"] == "x" and "z" not in found and "q" not in found


def test_clusters(build, rows):
    claims = [visit(n, "M", 5) for n in "ABC"] + [visit(n, "N", 5) for n in "CD"] + [visit(n, "O", 5) for n in "XY"]
    assert rows(provider_clusters(build(claims=claims), *YEAR, min_shared=1)) == [
        (n, "A", 4) for n in "ABCD"] + [("X", "X", 2), ("Y", "X", 2)]


def refer(source, target, count, **extra):
    return [{"referring_npi": source, "provider_npi": target, **extra}] * count


def test_referral_network_both_ends_and_top(build, rows):
    claims = refer("A", "B", 3) + refer("B", "B", 1) + refer(None, "B", 5) + refer("C", "B", 2)
    tables = build(claims=claims)
    assert rows(referral_network(tables, *YEAR), "provider_npi", "referring_npi", "rendering_npi") == [
        ("A", "A", "B"), ("B", "A", "B"), ("B", "B", "B"), ("B", "C", "B"), ("C", "C", "B"),
    ]
    assert rows(referral_network(tables, *YEAR, "B", top=1)) == [("B", "A", "B", 3, Decimal("300.00"), 1)]


def test_concentration_and_loops(build, rows):
    claims = refer("A", "A", 2) + refer("A", "B", 1) + refer("B", "A", 4) + refer("C", "A", 4) + refer("C", "B", 1)
    tables = build(claims=claims)
    assert rows(referral_concentration(tables, *YEAR), "provider_npi", "top_referrer", "top_share") == [
        ("A", "B", 0.4), ("B", "A", 0.5)]
    assert rows(referral_loops(tables, *YEAR)) == [("mutual", "A", "B", 1, 4), ("self", "A", "A", 2, 0)]


def test_shared_identity(build, rows):
    home = {"practice_state": "TX", "practice_city": "Austin", "practice_zip": "1"}
    providers = [{"npi": "A", "tax_id": "T", **home}, {"npi": "B", "tax_id": "T"},
                 {"npi": "C", "tax_id": None, **home}, {"npi": "D", "tax_id": None, "practice_state": "TX"}]
    tables = build(providers=providers)
    assert rows(shared_identity(tables)) == [("address", "TX|Austin|1", 2, "A", "C"), ("tax_id", "T", 2, "A", "B")]
    assert rows(shared_identity_members(tables), "kind", "provider_npi") == [
        ("address", "A"), ("address", "C"), ("tax_id", "A"), ("tax_id", "B")]


@pytest.mark.parametrize("days", [1, 7, 15, 16, 30, 45, 90])
def test_any_band_loses_no_pair(build, rows, days):
    random.seed(days)
    providers = [f"P{i}" for i in range(8)]
    claims = [visit(p, m, random.randint(-100, 150)) for p in providers for m in ("busy", "M1", "M2", "M3") for _ in range(4)]
    expected = brute_force(claims, 2, days)
    assert expected
    assert rows(shared_patient_edges(build(claims=claims), *YEAR, days=days, min_shared=2)) == expected


def test_no_caps_by_default(build, rows):
    claims = [row for i in range(60) for row in refer(f"R{i:02d}", "B", 1 + i % 3)]
    claims += [visit(f"P{i:02d}", "M", 5) for i in range(40)]
    tables = build(claims=claims)
    assert sum(r[0] == "B" for r in rows(referral_network(tables, *YEAR))) == 60
    partners = rows(shared_patients(tables, *YEAR, "P00", min_shared=1))
    assert len(partners) == 39
    scores = provider_scores(tables, *YEAR, concepts=["shared_patients"], options={"shared_patients": {"min_shared": 1}})
    assert {r.row_count for r in scores.where("provider_npi like 'P%'").collect()} == {39}
    asked = {"provider_npi": "B", "start_date": YEAR[0], "end_date": YEAR[1]}
    assert run("referral_network", tables, asked).count() == 50
    assert run("referral_network", tables, asked, top=None).count() == 60
    assert run("referral_network", tables, asked, top=None, limit=7).count() == 7
