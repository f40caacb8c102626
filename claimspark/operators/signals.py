"""Signals derived from the concept queries.

The thresholds and formulas here are this library's own: they put into numbers
what an investigator is asked to look for in the concept results.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import ratio, rounded
from claimspark.functions.periods import (
    CLAIMS,
    Providers,
    Tables,
    add_months,
    as_date,
    claim_count,
    claims_in,
    keep_providers,
    month_of,
)
from claimspark.functions.scratch import materialise_all
from claimspark.functions.spans import span_cover
from claimspark.operators.claims import claim_volume_by_period, claims_above_limit
from claimspark.operators.eligibility import retroactive_spans
from claimspark.operators.member import member_utilization_spike
from claimspark.operators.provider import provider_peer_comparison
from claimspark.operators.temporal import billing_spike_detection, day_number


def outlier_severity(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    notable: float = 2.0,
    critical: float = 3.0,
) -> DataFrame:
    """Providers whose larger z-score, before rounding, is above ``notable`` (high) or ``critical``."""
    z = F.greatest("z_claims", "z_allowed")
    return (
        provider_peer_comparison(tables, start, end, providers, exact=True)
        .withColumn("z_max", z)
        .where(F.col("z_max") > notable)
        .select(
            "provider_npi",
            *[rounded(F.col(name), 2).alias(name) for name in ("z_claims", "z_allowed", "z_max")],
            F.when(F.col("z_max") > critical, "critical").otherwise("high").alias("severity"),
        )
    )


def weekend_share(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    holidays: DataFrame | None = None,
    exact: bool = False,
) -> DataFrame:
    """Percentage of a provider's claims on weekends, against its specialty.

    Percentages are rounded for display unless ``exact`` is set.

    ``holidays`` (column ``holiday_date``) makes those days count as weekend.
    Claims are counted per provider before the join with specialties.
    """
    claims = claims_in(tables, start, end)
    off = day_number("service_date").isin(0, 6)
    if holidays is not None:
        listed = holidays.select(F.col("holiday_date").alias("service_date"), F.lit(True).alias("_holiday"))
        claims = (
            claims.groupBy("provider_npi", "service_date")
            .agg(claim_count(claims).alias("_n"), F.sum("allowed_amount").alias("_allowed"))
            .join(listed.distinct(), "service_date", "left")
        )
        off = off | F.coalesce("_holiday", F.lit(False))
        counted = (F.sum(F.when(off, F.col("_n")).otherwise(0)), F.sum("_n"), F.sum(F.when(off, F.col("_allowed"))))
    else:
        weekend = F.sum(F.when(off, F.col(CLAIMS)).otherwise(0)) if CLAIMS in claims.columns else F.count_if(off)
        counted = (weekend, claim_count(claims), F.sum(F.when(off, F.col("allowed_amount"))))
    own = claims.groupBy("provider_npi").agg(
        counted[0].alias("weekend_claims"), counted[1].alias("total_claims"),
        F.coalesce(counted[2], F.lit(0)).alias("weekend_allowed"),
    )
    specialties = tables["providers"].select(F.col("npi").alias("provider_npi"), "specialty")
    own = own.join(specialties, "provider_npi")
    peers = own.groupBy("specialty").agg(
        (F.sum("weekend_claims") * 100.0 / F.sum("total_claims")).alias("_peer")
    )
    share = F.col("weekend_claims") * 100.0 / F.col("total_claims")
    shown = (lambda value: value) if exact else (lambda value: rounded(value, 2))
    return keep_providers(own, providers).join(peers, "specialty").select(
        "provider_npi", "specialty", "weekend_claims", "total_claims", "weekend_allowed",
        shown(share).alias("weekend_pct"),
        shown(F.col("_peer")).alias("peer_pct"),
        shown(share - F.col("_peer")).alias("difference"),
    )


def ramp_up(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    min_ratio: float = 2.0,
    exact: bool = False,
) -> DataFrame:
    """Months with at least ``min_ratio`` times the previous active month's allowed sum.

    The ratio is rounded for display unless ``exact`` is set.
    """
    previous = F.lag("total_allowed").over(Window.partitionBy("provider_npi").orderBy("month"))
    return (
        claim_volume_by_period(tables, start, end, providers)
        .withColumn("previous_allowed", previous)
        .withColumn("_ratio", ratio(F.col("total_allowed"), F.col("previous_allowed")))
        .where(F.col("_ratio") >= min_ratio)
        .select("provider_npi", "month", "total_allowed", "previous_allowed", (F.col("_ratio") if exact else rounded(F.col("_ratio"), 2)).alias("ramp_ratio"))
    )


def seasonal_deviation(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """Monthly allowed sum against the same month one year earlier.

    Months are numbered, so the earlier month is a window frame of exactly twelve
    months before and no self join is needed.
    """
    number = F.year("month") * 12 + F.month("month")
    year_ago = Window.partitionBy("provider_npi").orderBy(number).rangeBetween(-12, -12)
    return (
        claim_volume_by_period(tables, add_months(start, -12), end, providers)
        .withColumn("last_year_allowed", F.max("total_allowed").over(year_ago))
        .where((F.col("month") >= F.lit(as_date(start))) & F.col("last_year_allowed").isNotNull())
        .select(
            "provider_npi", "month", "total_allowed", "last_year_allowed",
            rounded(ratio(F.col("total_allowed"), F.col("last_year_allowed")), 2).alias("seasonal_ratio"),
        )
    )


def phantom_billing(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """Claims whose member is unknown, was never covered, or both (``reason``)."""
    known = (
        tables["members"].select("member_id", F.lit(True).alias("_known"), F.lit(False).alias("_covered"))
        .unionByName(
            tables["eligibility"].select("member_id", F.lit(False).alias("_known"), F.lit(True).alias("_covered"))
        )
        .groupBy("member_id")
        .agg(F.bool_or("_known").alias("_known"), F.bool_or("_covered").alias("_covered"))
    )
    no_member = ~F.coalesce("_known", F.lit(False))
    no_cover = ~F.coalesce("_covered", F.lit(False))
    reason = (
        F.when(no_member & no_cover, "no_member_no_eligibility")
        .when(no_member, "no_member")
        .when(no_cover, "no_eligibility")
    )
    return (
        keep_providers(claims_in(tables, start, end), providers)
        .select("claim_id", "provider_npi", "member_id", "service_date", "allowed_amount")
        .join(known, "member_id", "left")
        .withColumn("reason", reason)
        .where("reason is not null")
        .select("claim_id", "provider_npi", "member_id", "service_date", "allowed_amount", "reason")
    )


def signal_pairs(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """Months in which two signals of a provider coincide.

    (pair, provider_npi, month, signals, amount): a billing spike with members
    whose use spikes; high-cost claims inside retroactive coverage; a billing
    spike with members whose coverage starts that month. ``signals`` counts the
    members or claims that coincide.
    """
    # Spikes and costly claims are few and used several times: each is found once and stored, side by side.
    stored = materialise_all(tables["claims"].sparkSession, {
        "spikes": lambda: billing_spike_detection(tables, start, end, providers).select(
            "provider_npi", "month", F.col("total_allowed").alias("amount")
        ),
        "costly-claims": lambda: claims_above_limit(tables, start, end, providers).select(
            "provider_npi", "member_id", "service_date", "allowed_amount"
        ),
    })
    spikes, costly = stored["spikes"], stored["costly-claims"]
    key = ["provider_npi", "month"]

    def pair(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("pair"), *key, "signals", "amount")

    busy = member_utilization_spike(tables, start, end, providers).groupBy(*key).agg(
        F.count("*").alias("signals")
    )
    late = span_cover(
        costly, retroactive_spans(tables["eligibility"]), "member_id", "service_date",
        "coverage_start", "coverage_end", start, end,
    ).where("covered")
    late_costly = (
        costly.join(late, ["member_id", "service_date"], "left_semi")
        .groupBy("provider_npi", month_of("service_date").alias("month"))
        .agg(F.count("*").alias("signals"), F.sum("allowed_amount").alias("amount"))
    )
    started = tables["eligibility"].select("member_id", month_of("coverage_start").alias("month")).distinct()
    enrolled = (
        keep_providers(claims_in(tables, start, end), providers)
        .select("provider_npi", "member_id", month_of("service_date").alias("month"))
        .distinct()
        .join(spikes.select(*key), key, "left_semi")
        .join(started, ["member_id", "month"], "left_semi")
        .groupBy(*key)
        .agg(F.count("*").alias("signals"))
    )
    return (
        pair("billing_and_utilisation", spikes.join(busy, key))
        .unionByName(pair("retroactive_and_high_cost", late_costly))
        .unionByName(pair("billing_and_enrolment", spikes.join(enrolled, key)))
    )


def employer_concentration(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """In billing-spike months, the employer group with the largest share of claims.

    The share is of all claims of the month, those of members without a known
    employer included. Claims are counted per member before members are joined.
    """
    key = ["provider_npi", "month"]
    spikes = billing_spike_detection(tables, start, end, providers).select(*key)
    per_member = (
        keep_providers(claims_in(tables, start, end), providers)
        .groupBy("provider_npi", month_of("service_date").alias("month"), "member_id")
        .agg(F.count("*").alias("_n"))
        .join(spikes, key, "left_semi")
    )
    per_employer = (
        per_member.join(tables["members"].select("member_id", "employer_group"), "member_id", "left")
        .groupBy(*key, "employer_group")
        .agg(F.sum("_n").alias("_n"))
    )
    named = F.col("employer_group").isNotNull()
    return (
        per_employer.groupBy(*key)
        .agg(
            F.min_by("employer_group", F.when(named, F.struct(-F.col("_n"), F.col("employer_group")))).alias("top_employer"),
            F.max(F.when(named, F.col("_n"))).alias("employer_claims"),
            F.sum("_n").alias("total_claims"),
        )
        .where("top_employer is not null")
        .withColumn("employer_share", rounded(ratio(F.col("employer_claims"), F.col("total_claims")), 4))
    )
