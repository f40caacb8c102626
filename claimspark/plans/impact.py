"""Money and risk per provider: overpayment, impact range, risk score, reports."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import rounded
from claimspark.functions.periods import as_date
from claimspark.plans.findings import SEVERITIES, findings

# Share of each domain in the composite risk score.
DOMAIN_WEIGHTS: Mapping[str, float] = {
    "claims": 0.25,
    "provider": 0.2,
    "member": 0.15,
    "eligibility": 0.15,
    "temporal": 0.15,
    "network": 0.1,
}

# Lowest score of each risk category.
RISK_CUTS = (("critical", 0.75), ("high", 0.6), ("medium", 0.3))


# Overpayment causes: the concept and the column of its score row.
OVERPAYMENT_CAUSES = {
    "upcoding": ("upcoding_pattern", "recoverable"),
    "duplicates": ("duplicate_claims", "recoverable"),
    "duplicate_copies": ("duplicate_claims", "certain"),
    "coverage_gaps": ("coverage_gap_claims", "recoverable"),
    "uncovered_once": ("coverage_gap_claims", "certain"),
    "mismatch_review": ("provider_specialty_mismatch", "amount"),
}
OVERPAYMENT_CONCEPTS = tuple(dict.fromkeys(concept for concept, _ in OVERPAYMENT_CAUSES.values()))


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0))


def overpayment(scores: DataFrame) -> DataFrame:
    """Estimated overpayment per provider, by cause.

    ``upcoding``: visits beyond the specialty's share of each code, at its mean
    price, at least zero. ``duplicates``: full amount of duplicate groups, of which
    ``duplicate_copies`` beyond the costliest copy. ``coverage_gaps``: full amount
    of uncovered claims, of which ``uncovered_once`` without further copies.
    ``mismatch_review`` is kept apart, for review. A claim that has two causes counts
    under both, but not in ``duplicate_copies`` and ``uncovered_once``.
    """
    return (
        scores.where(F.col("concept").isin(*OVERPAYMENT_CONCEPTS))
        .groupBy("provider_npi")
        .agg(*[
            F.coalesce(F.max(F.when(F.col("concept") == concept, F.col(column))), F.lit(0.0)).alias(cause)
            for cause, (concept, column) in OVERPAYMENT_CAUSES.items()
        ])
    )


def impact_summary(estimates: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Low, mid and high estimate per provider, and the mid estimate per year.

    Low: copies beyond the costliest, and uncovered claims that are not such copies.
    Mid: all copies, uncovered claims and upcoding. High: and procedures outside the
    specialty.
    """
    days = (as_date(end) - as_date(start)).days + 1
    low = F.col("duplicate_copies") + F.col("uncovered_once")
    mid = F.col("duplicates") + F.col("coverage_gaps") + F.col("upcoding")
    return estimates.select(
        "provider_npi",
        rounded(low, 2).alias("impact_low"),
        rounded(mid, 2).alias("impact_mid"),
        rounded(mid + F.col("mismatch_review"), 2).alias("impact_high"),
        rounded(mid * 365 / days, 2).alias("annualized_exposure"),
    )


def impact_rank(found: DataFrame) -> DataFrame:
    """Each provider's findings by recoverable amount, then confidence."""
    order = Window.partitionBy("provider_npi").orderBy(F.desc("recoverable"), F.desc("confidence"), "concept")
    return found.withColumn("impact_rank", F.row_number().over(order)).select(
        "provider_npi", "concept", "severity", "recoverable", "confidence", "impact_rank"
    )


def composite_risk(found: DataFrame, weights: Mapping[str, float] = DOMAIN_WEIGHTS) -> DataFrame:
    """Risk score from 0 to 1 per provider with findings, and its category.

    The score is the weighted mean, over all domains, of the heaviest severity
    found in each.
    """
    heaviest = [
        F.coalesce(F.max(F.when(F.col("domain") == domain, F.col("confidence"))), F.lit(0.0)) * weight
        for domain, weight in weights.items()
    ]
    total = sum(weights.values())
    score = rounded(sum(heaviest[1:], heaviest[0]) / total, 4)
    category = F.lit("low")
    for name, cut in reversed(RISK_CUTS):
        category = F.when(F.col("composite_risk_score") >= cut, name).otherwise(category)
    return (
        found.groupBy("provider_npi")
        .agg(score.alias("composite_risk_score"), F.count_distinct("domain").alias("domains"))
        .withColumn("risk_category", category)
    )


def report_rollup(scores: DataFrame, start: date | str, end: date | str, *, top: int | None = None) -> DataFrame:
    """One row per provider: finding counts, risk, impact range, its findings.

    ``scores`` is the stored table of ``provider_scores``.

    ``top_findings`` lists the findings, those that recover most first; ``top`` keeps as
    many. A provider has at most one per concept, so the list is short by construction.
    """
    found = findings(scores)
    counts = found.groupBy("provider_npi").agg(
        F.count("*").alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(f"{s}_findings") for s in SEVERITIES if s != "info"],
    )
    entry = F.struct("impact_rank", "concept", "severity", "recoverable")
    ranked = impact_rank(found)
    if top is not None:
        ranked = ranked.where(F.col("impact_rank") <= top)
    listed = ranked.groupBy("provider_npi").agg(F.sort_array(F.collect_list(entry)).alias("top_findings"))
    risk = composite_risk(found).drop("domains")
    joined = counts.join(risk, "provider_npi").join(listed, "provider_npi", "left")
    joined = joined.join(impact_summary(overpayment(scores), start, end), "provider_npi", "full")
    numbers = [c for c in joined.columns if c.endswith("_findings") and c != "top_findings"]
    money = ["impact_low", "impact_mid", "impact_high", "annualized_exposure"]
    return joined.select(
        "provider_npi",
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in numbers],
        _zero("composite_risk_score").alias("composite_risk_score"),
        F.coalesce("risk_category", F.lit("low")).alias("risk_category"),
        *[_zero(c).alias(c) for c in money],
        "top_findings",
    )


def top_providers(report: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` providers to follow up first, by risk score and then mid impact.

    The rows are cut to ``k`` before they are ranked, so the ranking window, which
    has no partitions, holds no more than that. Equal providers share a rank; of those
    that tie for the last places, the ones with the smaller id are listed.
    """
    order = [F.desc("composite_risk_score"), F.desc("impact_mid")]
    first = report.orderBy(*order, "provider_npi").limit(k)
    return first.select(
        F.rank().over(Window.orderBy(*order)).alias("follow_up_rank"),
        "provider_npi", "composite_risk_score", "risk_category", "total_findings", "impact_mid",
    )

