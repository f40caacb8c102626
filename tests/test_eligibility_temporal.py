from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from claimspark.functions.periods import add_months
from claimspark.operators.eligibility import coverage_gap_claims, retroactive_eligibility
from claimspark.operators.temporal import billing_spike_detection, weekend_billing

YEAR = ("2025-01-01", "2025-12-31")


def cover(start, end, member="M1", created=None, **extra):
    return {"member_id": member, "coverage_start": start, "coverage_end": end, "created_date": created or start, **extra}


def test_gap_bounds(build, rows):
    days = ["2025-02-28", "2025-03-01", "2025-03-31", "2025-04-01"]
    tables = build(claims=[{"service_date": d} for d in days], eligibility=[cover("2025-03-01", "2025-03-31")])
    assert rows(coverage_gap_claims(tables, *YEAR), "service_date") == [(date(2025, 2, 28),), (date(2025, 4, 1),)]


def test_gap_special_cases(build, rows):
    claims = [
        {"claim_id": "no member", "member_id": None}, {"claim_id": "never covered", "member_id": "X"},
        {"claim_id": "open start", "member_id": "Y"}, {"claim_id": "backwards", "member_id": "Z"},
        {"claim_id": "old cover", "member_id": "M1"}, {"claim_id": "long cover", "member_id": "L"},
    ]
    spans = [cover(None, "2025-12-31", "Y", "2025-01-01"), cover("2025-12-31", "2025-01-01", "Z"),
             cover("2024-01-01", "2024-12-31"), cover("2020-01-01", "2030-01-01", "L"),
             cover("2025-01-01", "2025-12-31", None)]
    found = rows(coverage_gap_claims(build(claims=claims, eligibility=spans), *YEAR), "claim_id")
    assert [r[0] for r in found] == ["backwards", "never covered", "no member", "old cover", "open start"]


def test_gap_ignores_status_unless_asked(build, rows):
    tables = build(claims=[{}], eligibility=[cover("2025-01-01", "2025-12-31", status="terminated")])
    assert rows(coverage_gap_claims(tables, *YEAR)) == []
    active = coverage_gap_claims(tables, *YEAR, counts_as_cover=F.col("status") == "active")
    assert active.count() == 1


def test_gap_equals_brute_force(build, rows):
    random.seed(5)
    day = lambda n: (date(2024, 11, 1) + timedelta(days=n)).isoformat()
    claims = [{"member_id": random.choice("KLM"), "service_date": day(random.randint(0, 450))} for _ in range(150)]
    spans = []
    for _ in range(25):
        start = random.randint(0, 450)
        spans.append(cover(day(start), day(start + random.randint(-5, 40)), random.choice("KLM")))
    expected = sorted(
        f"C{i}" for i, c in enumerate(claims)
        if YEAR[0] <= c["service_date"] <= YEAR[1] and not any(
            s["member_id"] == c["member_id"] and s["coverage_start"] <= c["service_date"] <= s["coverage_end"] for s in spans)
    )
    found = rows(coverage_gap_claims(build(claims=claims, eligibility=spans), *YEAR), "claim_id")
    assert [r[0] for r in found] == expected


def test_retroactive_limit_and_sums(build, rows):
    spans = [cover("2025-01-01", "2025-06-30", created="2025-01-31"), cover("2025-01-01", "2025-07-31", created="2025-02-01"),
             cover("2025-01-01", "2025-07-31", created="2025-02-01")]
    claims = [{"service_date": d} for d in ("2025-01-01", "2025-07-31", "2025-07-31", "2025-08-01")]
    assert rows(retroactive_eligibility(build(claims=claims, eligibility=spans), *YEAR)) == [
        ("A", "M1", date(2025, 1, 1), date(2025, 7, 31), date(2025, 2, 1), 31, 6, Decimal("600.00"))
    ], "each of two equal coverage rows counts the three claims"


def spend(amounts, start="2024-01-01"):
    return [{"service_date": add_months(start, i).isoformat(), "allowed_amount": a} for i, a in enumerate(amounts)]


def test_spike(build, rows):
    tables = build(claims=spend([100, 110, 90, 105, 95, 100, 110, 90, 105, 95, 100, 100, 900]))
    (found,) = rows(billing_spike_detection(tables, *YEAR), "month", "total_allowed", "rolling_avg", "z_score")
    assert found[:3] == (date(2025, 1, 1), Decimal("900.00"), 100.0) and found[3] > 3


def test_flat_history_and_short_history_give_no_spike(build, rows):
    assert rows(billing_spike_detection(build(claims=spend([100] * 12 + [900])), *YEAR)) == []
    assert rows(billing_spike_detection(build(claims=spend([100, 900], "2025-01-01")), *YEAR)) == []


def test_spike_uses_active_months_and_two_years(build, rows):
    old = [{"service_date": d, "allowed_amount": a} for d, a in
           [("2022-12-31", 5000), ("2023-01-05", 100), ("2023-09-05", 110), ("2025-05-05", 200)]]
    (found,) = rows(billing_spike_detection(build(claims=old), *YEAR), "month", "rolling_avg")
    assert found == (date(2025, 5, 1), 105.0)


def test_weekdays(build, rows):
    claims = [{"service_date": d} for d in ("2025-06-07", "2025-06-08", "2025-06-08", "2025-06-09")]
    assert rows(weekend_billing(build(claims=claims), *YEAR), "dow", "day_name", "claim_count") == [
        (0, "Sunday", 2), (1, "Monday", 1), (6, "Saturday", 1),
    ]


def test_add_months():
    assert add_months("2025-01-31", 1) == date(2025, 2, 28)
    assert add_months("2025-01-01", -24) == date(2023, 1, 1)
    assert add_months("2024-12-15", 1) == date(2025, 1, 15)
    assert add_months("2025-03-31", -1) == date(2025, 2, 28)
