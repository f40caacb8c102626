"""Member domain: doctor shopping and utilisation spikes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import ratio, rounded
from claimspark.functions.periods import Providers, Tables, add_months, as_date, claim_count, claims_in, keep_providers, month_of


def doctor_shopping(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    min_providers: int = 4,
    days: int = 30,
) -> DataFrame:
    """Members who saw many distinct providers for one diagnosis within ``days`` days.

    For each visit, the providers seen from ``days`` days before it up to that day
    are counted. All providers' visits count; ``providers`` narrows the answer to
    members they saw. The count is a running sum: a provider enters on each visit
    day and leaves when the visit expires or its next one takes over. Sums are
    combined per day first, so a diagnosis of one member never holds more rows in
    a window than the period has days, however many claims it has.
    """
    claims = claims_in(tables, start, end).dropna(
        subset=["member_id", "diagnosis_code", "provider_npi"]
    )
    if providers is not None:
        touched = keep_providers(claims, providers).select("member_id").distinct()
        claims = claims.join(touched, "member_id", "left_semi")
    case = ["member_id", "diagnosis_code"]
    visits = claims.select(*case, "provider_npi", "service_date").distinct()
    same_provider = Window.partitionBy(*case, "provider_npi").orderBy("service_date")
    expiry = F.date_add("service_date", days + 1)
    leaves = F.least(expiry, F.coalesce(F.lead("service_date").over(same_provider), expiry))
    changes = visits.withColumn("_leaves", leaves).select(
        *case,
        F.explode(
            F.array(
                F.struct(F.col("service_date").alias("day"), F.lit(1).alias("change"), F.lit(True).alias("visit")),
                F.struct(F.col("_leaves").alias("day"), F.lit(-1).alias("change"), F.lit(False).alias("visit")),
            )
        ).alias("event"),
    )
    per_day = changes.groupBy(*case, F.col("event.day").alias("day")).agg(
        F.sum("event.change").alias("change"), F.bool_or("event.visit").alias("visit")
    )
    upto = Window.partitionBy(*case).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_day.withColumn("provider_count_30d", F.sum("change").over(upto))
        .where(F.col("visit") & (F.col("provider_count_30d") >= min_providers))
        .select(*case, "provider_count_30d")
        .distinct()
    )


def doctor_shopping_by_provider(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    min_providers: int = 4,
    days: int = 30,
) -> DataFrame:
    """Doctor-shopping cases listed under every provider that billed for them.

    (provider_npi, member_id, diagnosis_code, provider_count_30d, claims,
    total_allowed), with the case's highest provider count.
    """
    case = ["member_id", "diagnosis_code"]
    cases = (
        doctor_shopping(tables, start, end, providers, min_providers=min_providers, days=days)
        .groupBy(*case)
        .agg(F.max("provider_count_30d").alias("provider_count_30d"))
    )
    billed = (
        keep_providers(claims_in(tables, start, end), providers)
        .groupBy("provider_npi", *case)
        .agg(F.count("*").alias("claims"), F.sum("allowed_amount").alias("total_allowed"))
    )
    return billed.join(cases, case).select(
        "provider_npi", *case, "provider_count_30d", "claims", "total_allowed"
    )


def member_utilization_spike(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    factor: float = 3.0,
    months: int = 6,
    across_providers: bool = False,
    exact: bool = False,
) -> DataFrame:
    """Months in which a member has more than ``factor`` times its usual claims.

    The usual level is the mean of up to ``months`` earlier active months, looked
    up from ``months`` months before the start. Counts are per (provider, member);
    ``across_providers`` counts all of a member's claims instead. A first month has
    no earlier level: it is listed, with NULL average and ratio. A period that
    starts within a month leaves that month out. The ratio is rounded for display
    unless ``exact`` is set.
    """
    claims = claims_in(tables, add_months(start, -months), end)
    if across_providers:
        owner = ["member_id"]
        if providers is not None:
            seen = keep_providers(claims_in(tables, start, end), providers).select("member_id").distinct()
            claims = claims.join(seen, "member_id", "left_semi")
    else:
        owner = ["provider_npi", "member_id"]
        claims = keep_providers(claims, providers)
    monthly = claims.groupBy(*owner, month_of("service_date").alias("month")).agg(
        claim_count(claims).alias("monthly_claims")
    )
    earlier = Window.partitionBy(*owner).orderBy("month").rowsBetween(-months, -1)
    usual = F.col("_usual")
    spike = ratio(F.col("monthly_claims"), usual)
    return (
        monthly.withColumn("_usual", F.avg("monthly_claims").over(earlier))
        .where(
            (F.col("month") >= F.lit(as_date(start)))
            & (F.col("monthly_claims") > factor * F.coalesce(usual, F.lit(0.0)))
        )
        .select(
            *owner, "month", "monthly_claims",
            rounded(usual, 1).alias("avg_6m"),
            (spike if exact else rounded(spike, 1)).alias("spike_ratio"),
        )
    )
