from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimspark.functions import percentiles
from claimspark.functions.percentiles import clipped, exact_percentile, percentile_by_brackets
from claimspark.operators.claims import (
    claim_volume_by_period,
    duplicate_claims,
    high_cost_claims,
    upcoding_pattern,
)

YEAR = ("2025-01-01", "2025-12-31")


def test_percentile_equals_interpolation(spark):
    random.seed(7)
    data = []
    for group, size in {"a": 1, "b": 2, "c": 57, "d": 1000}.items():
        data += [(group, Decimal(random.randint(-10**9, 10**9)) / 100) for _ in range(size)]
    data += [("e", Decimal("10.00"))] * 50 + [("e", Decimal("99999999.99"))] * 3 + [("e", None)]
    df = spark.createDataFrame(data, "k string, v decimal(12,2)")
    for fraction in (0, 0.5, 0.95, 1):
        found = {r.k: r.p for r in exact_percentile(df, ["k"], "v", fraction, "p").collect()}
        for group in "abcde":
            values = [float(v) for k, v in data if k == group and v is not None]
            assert abs(float(found[group]) - np.percentile(values, fraction * 100)) < 1e-4


def test_high_cost_is_strictly_above_and_uses_all_providers(build, rows):
    claims = [{"provider_npi": "B", "procedure_code": "P", "service_state": "TX", "allowed_amount": 10}] * 19
    claims += [{"provider_npi": "A", "procedure_code": "P", "service_state": "TX", "allowed_amount": 30}]
    claims += [{"provider_npi": "A", "procedure_code": None, "service_state": "TX", "allowed_amount": 999}]
    found = rows(high_cost_claims(build(claims=claims), *YEAR), "provider_npi", "p95", "cost_ratio")
    # rank 0.95 * 19 = 18.05: between 10 and 30
    assert found == [("A", 11.0, 2.73)]


def test_high_cost_zero_limit_has_no_ratio(build, rows):
    claims = [{"procedure_code": "P", "service_state": "TX", "allowed_amount": a} for a in [0] * 99 + [5]]
    assert rows(high_cost_claims(build(claims=claims), *YEAR), "p95", "cost_ratio") == [(0.0, None)]


def test_upcoding_against_specialty(build, rows):
    providers = [{"npi": n, "specialty": "IM"} for n in "AB"] + [{"npi": "X", "specialty": None}]
    high = [{"provider_npi": "A", "procedure_code": "99215"}] * 8 + [{"provider_npi": "A", "procedure_code": "99213"}] * 2
    flat = [{"provider_npi": "B", "procedure_code": "99213"}] * 10
    other = [{"provider_npi": "X", "procedure_code": "99213"}, {"provider_npi": "A", "procedure_code": "12345"}]
    tables = build(claims=high + flat + other, providers=providers)
    assert rows(upcoding_pattern(tables, *YEAR)) == [
        ("A", "99213", 20.0, 60.0, -40.0), ("A", "99215", 80.0, 40.0, 40.0), ("B", "99213", 100.0, 60.0, 40.0),
    ]
    assert rows(upcoding_pattern(tables, *YEAR, "B")) == [("B", "99213", 100.0, 60.0, 40.0)]
    alone = rows(upcoding_pattern(tables, *YEAR, exclude_self=True), "provider_npi", "procedure_code", "peer_pct")
    assert alone == [("A", "99213", 100.0), ("A", "99215", 0.0), ("B", "99213", 20.0)]


def test_duplicates_need_all_four_keys(build, rows):
    same = {"member_id": "M", "procedure_code": "P", "service_date": "2025-03-03"}
    claims = [same, same, {**same, "procedure_code": "Q"}, {**same, "service_date": "2025-03-04"}]
    claims += [{**same, "service_date": "2024-12-31"}] * 2
    assert rows(duplicate_claims(build(claims=claims), *YEAR)) == [
        ("A", "M", "P", date(2025, 3, 3), 2, Decimal("200.00"))
    ]


def test_volume_by_month(build, rows):
    claims = [{"service_date": "2025-01-01", "allowed_amount": 10}, {"service_date": "2025-01-31", "allowed_amount": 5},
              {"service_date": "2025-12-31", "allowed_amount": None}, {"service_date": "2026-01-01"}]
    assert rows(claim_volume_by_period(build(claims=claims), *YEAR)) == [
        ("A", date(2025, 1, 1), 2, Decimal("15.00"), 7.5), ("A", date(2025, 12, 1), 1, None, None),
    ]


def test_provider_filters_agree(build, spark, rows):
    tables = build(claims=[{"provider_npi": n, "service_date": "2025-02-02"} for n in "AABC"])
    by_name = rows(claim_volume_by_period(tables, *YEAR, ["A", "B"]))
    frame = spark.createDataFrame([("A",), ("B",), ("B",)], "npi string")
    assert by_name == rows(claim_volume_by_period(tables, *YEAR, frame))
    assert by_name == rows(claim_volume_by_period(tables, *YEAR).where(F.col("provider_npi") != "C"))


@pytest.mark.parametrize("fraction", ["0", "0.5", "0.95", "0.99995", "0.123456", "1"])
def test_percentile_of_any_fraction(spark, fraction):
    values = list(range(0, 200_001, 7))
    df = spark.createDataFrame([("k", v / 100) for v in values], "k string, v double")
    found = exact_percentile(df, ["k"], "v", fraction, "p").first().p
    place = Decimal(fraction) * (len(values) - 1)
    low = values[int(place)]
    high = values[min(int(place) + 1, len(values) - 1)]
    assert abs(found - (low + (high - low) * (place - int(place))) / 100) <= Decimal("0.000001")


def test_percentile_keeps_cents_of_doubles(spark):
    df = spark.createDataFrame([("k", 0.29), ("k", 1.13)], "k string, v double")
    assert [exact_percentile(df, ["k"], "v", f, "p").first().p for f in ("0", "1")] == [Decimal("0.29"), Decimal("1.13")]


@pytest.mark.parametrize("fraction", ["0", "0.5", "0.95", "1"])
def test_percentile_by_brackets(spark, fraction):
    # a group of 60,000 rows and some 50,000 amounts, one with few amounts, one of one row; nulls do not count
    rows = spark.range(60_100).selectExpr(
        "case when id < 60000 then 'large' when id < 60099 then 'ties' else 'one' end k",
        "cast(if(id < 60000, pmod(xxhash64(id), 200000) / 100, id % 3) as decimal(12,2)) v",
    ).union(spark.sql("select 'ties', cast(null as decimal(12,2))"))
    plain = sorted(map(tuple, exact_percentile(rows, ["k"], "v", fraction, "p").collect()))
    assert len(plain) == 3
    assert sorted(map(tuple, percentile_by_brackets(rows, ["k"], "v", fraction, "p").collect())) == plain
    # a summary that is too rough to bracket anything is seen, and its groups are found again
    assert sorted(map(tuple, percentile_by_brackets(rows, ["k"], "v", fraction, "p", accuracy=4).collect())) == plain


def test_brackets_leave_few_values(spark):
    rows = spark.range(60_000).selectExpr("'large' k", "pmod(xxhash64(id), 2000000) _cents")
    values = rows.select("_cents").distinct().count()
    assert clipped(rows, ["k"], "0.95", 1000).select("_cents").distinct().count() < values / 10


def test_missed_brackets_are_found_again(spark, monkeypatch):
    rows = spark.range(5_000).selectExpr("'large' k", "cast(id as decimal(12,2)) v")

    def wrong(rows, keys, fraction, accuracy):
        ends = rows.withColumns({"_below": F.lit(0).cast("long"), "_above": F.lit(100).cast("long")})
        return ends.withColumn("_cents", F.greatest(F.least("_cents", "_above"), F.col("_below")))

    monkeypatch.setattr(percentiles, "clipped", wrong)
    found = percentile_by_brackets(rows, ["k"], "v", "0.95", "p").collect()
    assert found == exact_percentile(rows, ["k"], "v", "0.95", "p").collect()
