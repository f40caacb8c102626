"""The rollup after loads and retractions against the claims themselves."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from checks import spark_queries
from claimspark.operators.claims import claim_volume_by_period
from claimspark.operators.member import member_utilization_spike
from claimspark.operators.provider import provider_peer_comparison
from claimspark.operators.signals import ramp_up, seasonal_deviation, weekend_share
from claimspark.operators.temporal import billing_spike_detection, weekend_billing
from claimspark.streaming.ingest import append_new, create_target
from claimspark.streaming.rollup import _sums, add_claims, create_rollup, refresh, retract, summed_claims, with_rollup

YEAR = ("2025-01-01", "2025-12-31")
CONCEPTS = [
    claim_volume_by_period, provider_peer_comparison, member_utilization_spike, billing_spike_detection,
    weekend_billing, weekend_share, ramp_up, seasonal_deviation,
]


def results(tables):
    return {
        concept.__name__: sorted(tuple(str(v) for v in r) for r in concept(tables, *YEAR).collect()) for concept in CONCEPTS
    }


@pytest.fixture
def many(build):
    rng = random.Random(4)
    claims = []
    for n in range(900):
        day = date(2023, 6, 1) + timedelta(days=31 * rng.randint(0, 29) + rng.choice([0, 1, 9]))
        provider = rng.choice(["P1", "P1", "P1", "P2", "P3", "P4", None])  # one holds most claims
        amount = None if n % 17 == 0 else rng.randint(1, 9) * (40 if provider == "P2" and day.month == 11 else 1)
        claims.append({
            "provider_npi": provider, "member_id": rng.choice(["M1", "M2", "M3", None]), "allowed_amount": amount,
            "service_date": None if n % 97 == 0 else day.isoformat(), "claim_status": rng.choice(["PAID", "PAID", "DENIED"]),
        })
    providers = [{"npi": f"P{n}", "specialty": "IM", "practice_state": "TX"} for n in range(1, 5)]
    return build(claims=claims, providers=providers)


def test_three_loads_and_a_retraction_equal_a_recompute(spark, many, tmp_path):
    target, index, rollup = (f"{tmp_path}/{name}" for name in ("claims", "claims.index", "rollup"))
    create_target(spark, "claims", target, index)
    create_rollup(spark, rollup)
    parts = [many["claims"].where(F.pmod(F.xxhash64("claim_id"), F.lit(3)) == n) for n in range(3)]
    for n, part in enumerate([parts[0], parts[1].unionByName(parts[0]), parts[2]]):
        append_new(spark, "claims", part, target, index, 2)
        if n != 1:  # the second load is caught up with by the third refresh
            refresh(spark, target, rollup)
    assert refresh(spark, target, rollup) == []
    assert results(with_rollup(many, spark, rollup)) == results(many)
    denied = many["claims"].where("claim_status = 'DENIED'")
    for _ in range(2):  # a retraction that is run again counts once
        retract(denied, rollup, 1)
    paid = {**many, "claims": many["claims"].where("claim_status = 'PAID'")}
    assert results(with_rollup(many, spark, rollup)) == results(paid)
    retract(paid["claims"], rollup, 2)
    assert summed_claims(spark, rollup).collect() == []


def test_a_load_touches_only_its_days(spark, build, tmp_path):
    rollup = f"{tmp_path}/rollup"
    create_rollup(spark, rollup)
    first = build(claims=[{"service_date": "2025-01-01"}, {"service_date": "2025-01-02"}])["claims"]
    add_claims(first, rollup, 0)
    files = lambda: {(f, os.path.getmtime(os.path.join(at, f))) for at, _, names in os.walk(rollup) for f in names if f.endswith(".parquet")}
    before = files()
    add_claims(build(claims=[{"service_date": "2025-01-02"}, {"service_date": "2025-02-03"}])["claims"], rollup, 1)
    assert files() > before and spark.read.parquet(rollup).where("load = 1").count() == 2
    held = {str(r.service_date): r.claims_summed for r in summed_claims(spark, rollup).collect()}
    assert held == {"2025-01-01": 1, "2025-01-02": 2, "2025-02-03": 1}
    one = summed_claims(spark, rollup, "2025-01-02", "2025-01-31")
    assert [r.claims_summed for r in one.collect()] == [2]
    assert "service_month" in one._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    for wrong in (lambda: add_claims(first, rollup, -1), lambda: retract(first, rollup, 0)):
        with pytest.raises(ValueError):
            wrong()


def test_sums_are_shuffled_once(build):
    """Claims go to the task that writes their sum; a sum of many claims is one row."""
    same = {"provider_npi": "P1", "member_id": "M1", "service_date": "2025-03-04", "allowed_amount": 2}
    rows = [same] * 50 + [{**same, "allowed_amount": None}, {**same, "member_id": None}, {**same, "service_date": None}]
    sums = _sums(build(claims=rows)["claims"], 3, -1)
    found = {(r.member_id, str(r.service_date), r.claims, r.priced, int(r.allowed), r.load) for r in sums.collect()}
    assert found == {("M1", "2025-03-04", -51, -50, -100, 3), (None, "2025-03-04", -1, -1, -2, 3), ("M1", "None", -1, -1, -2, 3)}
    assert sums._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange ") == 1


def test_claims_are_made_once_for_all_loads(build, spark, monkeypatch):
    """The registered rollups read a written table in their loads, not the joins that make the claims."""
    tables = build(claims=[{"provider_npi": "P1", "member_id": "M1", "service_date": "2000-03-04", "diagnosis_code": d, "allowed_amount": 60_000} for d in "135"])
    seen = []
    monkeypatch.setattr(spark_queries, "claims_tables", lambda spark, sf_dir: tables)
    for name in ("add_claims", "retract"):
        run = getattr(spark_queries, name)
        monkeypatch.setattr(spark_queries, name, lambda claims, *a, run=run: (seen.append(claims), run(claims, *a)))
    left = spark_queries.rollup_of(spark, "")["claims"].collect()
    assert left == []  # all three are rejected afterwards
    assert len(seen) == 4 and all("priced_claims" in f for claims in seen for f in claims.inputFiles())
    assert all(claims.inputFiles() for claims in seen)
