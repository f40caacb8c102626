from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from claimspark.functions.periods import add_months
from claimspark.operators.signals import (
    employer_concentration,
    outlier_severity,
    phantom_billing,
    ramp_up,
    seasonal_deviation,
    signal_pairs,
    weekend_share,
)

YEAR = ("2025-01-01", "2025-12-31")


def test_outlier_bounds(build, rows):
    counts = {f"P{i:02d}": 1 for i in range(12)} | {"X": 60}
    claims = [{"provider_npi": n, "allowed_amount": 1} for n, k in counts.items() for _ in range(k)]
    providers = [{"npi": n, "specialty": "IM", "practice_state": "TX"} for n in counts]
    tables = build(claims=claims, providers=providers)
    assert rows(outlier_severity(tables, *YEAR), "provider_npi", "severity") == [("X", "critical")]
    assert rows(outlier_severity(tables, *YEAR, critical=5), "severity") == [("high",)]


def test_weekend_share_and_holidays(build, spark, rows):
    claims = [{"provider_npi": "A", "service_date": d} for d in ("2025-06-07", "2025-06-09")]
    claims += [{"provider_npi": "B", "service_date": d} for d in ("2025-06-09", "2025-07-04")]
    tables = build(claims=claims, providers=[{"npi": n, "specialty": "IM"} for n in "AB"])
    columns = ("provider_npi", "weekend_claims", "weekend_pct", "peer_pct", "difference")
    assert rows(weekend_share(tables, *YEAR), *columns) == [("A", 1, 50.0, 25.0, 25.0), ("B", 0, 0.0, 25.0, -25.0)]
    holidays = spark.createDataFrame([(date(2025, 7, 4),)], "holiday_date date")
    assert rows(weekend_share(tables, *YEAR, holidays=holidays), *columns) == [
        ("A", 1, 50.0, 50.0, 0.0), ("B", 1, 50.0, 50.0, 0.0)]


def test_ramp_and_season(build, rows):
    claims = [{"service_date": d, "allowed_amount": a} for d, a in
              [("2024-03-05", 50), ("2025-01-05", 100), ("2025-03-05", 250), ("2025-04-05", 300)]]
    tables = build(claims=claims)
    assert rows(ramp_up(tables, *YEAR), "month", "ramp_ratio") == [(date(2025, 3, 1), 2.5)]
    assert rows(seasonal_deviation(tables, *YEAR), "month", "last_year_allowed", "seasonal_ratio") == [
        (date(2025, 3, 1), Decimal("50.00"), 5.0)]


def test_phantom_reasons(build, rows):
    tables = build(
        claims=[{"member_id": m} for m in ("both", "member", "cover", "none", None)],
        members=[{"member_id": m} for m in ("both", "member")],
        eligibility=[{"member_id": m} for m in ("both", "cover", "cover")],
    )
    assert rows(phantom_billing(tables, *YEAR), "member_id", "reason") == [
        (None, "no_member_no_eligibility"), ("cover", "no_member"),
        ("member", "no_eligibility"), ("none", "no_member_no_eligibility")]


@pytest.fixture
def kickback(build):
    """Twelve quiet months, then a spike whose members work for one employer."""
    quiet = [{"service_date": add_months("2024-01-01", i).isoformat(), "allowed_amount": 100 + i % 3,
              "member_id": "OLD", "procedure_code": "P", "service_state": "TX"} for i in range(12)]
    spike = [{"service_date": "2025-01-15", "allowed_amount": 500 + i, "member_id": f"N{i}",
              "procedure_code": "P", "service_state": "TX"} for i in range(5)]
    members = [{"member_id": f"N{i}", "employer_group": "ACME"} for i in range(5)]
    cover = [{"member_id": f"N{i}", "coverage_start": date(2025, 1, 1), "coverage_end": date(2025, 12, 31),
              "created_date": date(2025, 3, 1)} for i in range(5)]
    return build(claims=quiet + spike, members=members, eligibility=cover)


def test_pairs_and_employers(kickback, rows):
    month = date(2025, 1, 1)
    assert rows(signal_pairs(kickback, *YEAR), "pair", "provider_npi", "month", "signals") == [
        ("billing_and_enrolment", "A", month, 5), ("billing_and_utilisation", "A", month, 5),
        ("retroactive_and_high_cost", "A", month, 1)]
    assert rows(employer_concentration(kickback, *YEAR)) == [("A", month, "ACME", 5, 5, 1.0)]


def test_rounding_once(spark):
    from claimspark.functions.numbers import rounded

    values = [(2.0049999, 2.0), (1.005, 1.01), (2.675, 2.68), (-1.005, -1.01), (0.125, 0.13), (1617517.575, 1617517.58)]
    df = spark.createDataFrame([(v,) for v, _ in values], "v double")
    assert [r[0] for r in df.select(rounded(F.col("v"), 2)).collect()] == [e for _, e in values]
