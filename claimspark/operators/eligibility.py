"""Eligibility domain: claims without cover and cover added after the fact."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.periods import Providers, Tables, as_date, claims_in, keep_providers
from claimspark.functions.spans import span_cover


def coverage_gap_claims(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    counts_as_cover: Column | None = None,
) -> DataFrame:
    """Claims whose service date lies in none of the member's coverage spans.

    Both ends of a span count. Status and coverage type are ignored unless
    ``counts_as_cover`` filters the eligibility rows. Claims are never paired with
    spans; the uncovered (member, day) pairs are found first and joined back.
    """
    eligibility = tables["eligibility"]
    if counts_as_cover is not None:
        eligibility = eligibility.where(counts_as_cover)
    claims = keep_providers(claims_in(tables, start, end), providers).select(
        "claim_id", "provider_npi", "member_id", "service_date", "procedure_code", "allowed_amount"
    )
    cover = span_cover(
        claims, eligibility, "member_id", "service_date", "coverage_start", "coverage_end", start, end
    )
    gaps = cover.where(~F.col("covered")).select(
        F.col("member_id").alias("_member"), F.col("service_date").alias("_day")
    )
    # Null-safe, because a claim without a member has no cover either.
    same = F.col("member_id").eqNullSafe(F.col("_member")) & (F.col("service_date") == F.col("_day"))
    return claims.join(gaps, same, "left_semi")


def retroactive_spans(eligibility: DataFrame, min_days: int = 30) -> DataFrame:
    """Coverage rows created more than ``min_days`` days after their start."""
    late = F.date_diff("created_date", "coverage_start")
    return eligibility.where(late > min_days).withColumn("days_retroactive", late)


def retroactive_eligibility(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    min_days: int = 30,
) -> DataFrame:
    """Late coverage rows with each provider's claims inside that coverage.

    Claims are first summed per (provider, member, day). The spans, cut to the
    period, are listed once per month they touch and joined on (member, month), so
    the work of one busy member spreads over the months and the final sum, which
    is keyed differently, combines before its shuffle.
    """
    span = ["member_id", "coverage_start", "coverage_end", "created_date", "days_retroactive"]
    daily = (
        keep_providers(claims_in(tables, start, end), providers)
        .where(F.col("member_id").isNotNull())
        .groupBy("provider_npi", "member_id", "service_date")
        .agg(F.count("claim_id").alias("_claims"), F.sum("allowed_amount").alias("_allowed"))
        .withColumn("_month", F.trunc("service_date", "month"))
    )
    lower, upper = F.lit(as_date(start)), F.lit(as_date(end))
    spans = (
        retroactive_spans(tables["eligibility"], min_days)
        .where((F.col("coverage_end") >= lower) & (F.col("coverage_start") <= upper)
               & (F.col("coverage_start") <= F.col("coverage_end")))
        .groupBy(*span)
        .agg(F.count("*").alias("_copies"))
        .withColumn(
            "_month",
            F.explode(
                F.sequence(
                    F.trunc(F.greatest("coverage_start", lower), "month"),
                    F.trunc(F.least("coverage_end", upper), "month"),
                    F.expr("interval 1 month"),
                )
            ),
        )
    )
    return (
        daily.join(spans, ["member_id", "_month"])
        .where(F.col("service_date").between(F.col("coverage_start"), F.col("coverage_end")))
        .groupBy("provider_npi", *span)
        .agg(
            F.sum(F.col("_claims") * F.col("_copies")).alias("claims_in_period"),
            F.sum(F.col("_allowed") * F.col("_copies")).cast("decimal(22,2)").alias("total_allowed"),
        )
    )
