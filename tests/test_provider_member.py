from __future__ import annotations

import random
from datetime import date, timedelta

import pytest

from claimspark.operators.member import (
    doctor_shopping,
    doctor_shopping_by_provider,
    member_utilization_spike,
)
from claimspark.operators.provider import provider_peer_comparison, provider_specialty_mismatch

YEAR = ("2025-01-01", "2025-12-31")


def place(npi, specialty="IM", state="TX"):
    return {"npi": npi, "specialty": specialty, "practice_state": state}


def test_peer_scores(build, rows):
    providers = [place(n) for n in "ABC"] + [place("L", state="NY")]
    claims = [{"provider_npi": n} for n in "ABBCCCLU"]
    found = {r[0]: r for r in rows(provider_peer_comparison(build(claims=claims, providers=providers), *YEAR))}
    assert [found[n][5] for n in "ABC"] == [-1.0, 0.0, 1.0]
    assert found["L"][5:] == (None, None), "a group of one has no spread"
    assert found["U"][5:] == (None, None), "an unknown provider has no group"
    assert found["C"][4] == 1


def test_peer_scores_without_self(build, rows):
    counts = {"A": 2, "B": 4, "C": 9, "D": 5}
    claims = [{"provider_npi": n, "allowed_amount": 1} for n, k in counts.items() for _ in range(k)]
    tables = build(claims=claims, providers=[place(n) for n in counts])
    found = {r[0]: r[1] for r in rows(provider_peer_comparison(tables, *YEAR, exclude_self=True), "provider_npi", "z_claims")}
    for name, own in counts.items():
        others = [k for n, k in counts.items() if n != name]
        mean = sum(others) / 3
        std = (sum((k - mean) ** 2 for k in others) / 2) ** 0.5
        assert found[name] == pytest.approx((own - mean) / std, abs=0.006)


def test_equal_peers_have_no_score(build, rows):
    claims = [{"provider_npi": n} for n in "AABB"]
    tables = build(claims=claims, providers=[place("A"), place("B")])
    assert rows(provider_peer_comparison(tables, *YEAR), "z_claims", "z_allowed") == [(None, None)] * 2


def test_mismatch_default_and_literal(build, rows):
    mapping = [{"procedure_code": "99395", "expected_specialty": s} for s in ("Internal Medicine", "Pediatrics")]
    mapping.append({"procedure_code": "43239", "expected_specialty": "Gastro"})
    claims = [{"procedure_code": "99395"}, {"procedure_code": "43239"}, {"procedure_code": "99213"},
              {"procedure_code": "99395", "provider_npi": "D"}]
    providers = [place("A", "Internal Medicine"), place("D", "Dental"), place("N", None)]
    claims.append({"procedure_code": "43239", "provider_npi": "N"})
    tables = build(claims=claims, providers=providers, specialty_procedure_map=mapping)
    columns = ("provider_npi", "procedure_code", "procedure_specialty")
    assert rows(provider_specialty_mismatch(tables, *YEAR), *columns) == [
        ("A", "43239", "Gastro"), ("D", "99395", "Internal Medicine|Pediatrics"),
    ]
    assert rows(provider_specialty_mismatch(tables, *YEAR, literal=True), *columns) == [
        ("A", "43239", "Gastro"), ("A", "99395", "Pediatrics"),
        ("D", "99395", "Internal Medicine"), ("D", "99395", "Pediatrics"),
    ]


def visit(member, npi, day, diagnosis="J1"):
    return {"member_id": member, "provider_npi": npi, "diagnosis_code": diagnosis,
            "service_date": (date(2025, 1, 1) + timedelta(days=day)).isoformat()}


def test_shopping_window(build, rows):
    six = [visit("M", f"P{i}", i * 5) for i in range(6)]
    assert rows(doctor_shopping(build(claims=six), *YEAR)) == [("M", "J1", k) for k in (4, 5, 6)]
    edge = [visit("M", f"P{i}", d) for i, d in enumerate((0, 10, 20, 30))]
    assert rows(doctor_shopping(build(claims=edge), *YEAR)) == [("M", "J1", 4)], "day 30 still counts"
    late = [visit("M", f"P{i}", d) for i, d in enumerate((0, 10, 20, 31))]
    assert rows(doctor_shopping(build(claims=late), *YEAR)) == [], "day 31 does not"
    mixed = [visit("M", f"P{i}", i, f"J{i % 2}") for i in range(6)] + [visit("M", f"P{i}", i, None) for i in range(6)]
    assert rows(doctor_shopping(build(claims=mixed), *YEAR)) == []


def test_shopping_equals_brute_force(build, rows):
    random.seed(3)
    visits = [(random.choice("MN"), random.choice("PQRSTU"), random.randint(0, 200)) for _ in range(160)]
    tables = build(claims=[visit(*v) for v in visits])
    expected = set()
    for member, _, day in visits:
        seen = {p for m, p, d in visits if m == member and day - 30 <= d <= day}
        if len(seen) >= 3:
            expected.add((member, "J1", len(seen)))
    assert set(rows(doctor_shopping(tables, *YEAR, min_providers=3))) == expected


def test_shopping_by_target(build, rows):
    claims = [visit("M", f"P{i}", i) for i in range(4)] + [visit("N", f"Q{i}", i) for i in range(4)]
    tables = build(claims=claims)
    assert rows(doctor_shopping(tables, *YEAR, "P1")) == [("M", "J1", 4)]
    assert rows(doctor_shopping_by_provider(tables, *YEAR, "P1"), "provider_npi", "member_id", "claims") == [("P1", "M", 1)]
    assert len(rows(doctor_shopping_by_provider(tables, *YEAR))) == 8


def months(counts, **extra):
    return [{"service_date": f"2025-{m:02d}-10", **extra} for m, k in counts.items() for _ in range(k)]


def test_utilisation_spike(build, rows):
    tables = build(claims=months({1: 1, 2: 1, 3: 1, 4: 4}))
    columns = ("month", "monthly_claims", "avg_6m", "spike_ratio")
    assert rows(member_utilization_spike(tables, *YEAR), *columns) == [
        (date(2025, 1, 1), 1, None, None), (date(2025, 4, 1), 4, 1.0, 4.0),
    ]
    assert rows(member_utilization_spike(tables, "2025-04-15", "2025-12-31")) == [], "a part month is left out"
    assert rows(member_utilization_spike(tables, "2025-04-01", "2025-12-31"), *columns) == [(date(2025, 4, 1), 4, 1.0, 4.0)]


def test_utilisation_across_providers(build, rows):
    claims = months({1: 2}, provider_npi="A") + months({1: 1}, provider_npi="B") + months({2: 10}, provider_npi="B")
    claims += months({2: 9}, provider_npi="B", member_id="Z")
    tables = build(claims=claims)
    columns = ("member_id", "month", "spike_ratio")
    assert (("M1", date(2025, 2, 1), 3.3)) in rows(member_utilization_spike(tables, *YEAR, across_providers=True), *columns)
    touched = rows(member_utilization_spike(tables, *YEAR, "A", across_providers=True), *columns)
    assert {r[0] for r in touched} == {"M1"}
