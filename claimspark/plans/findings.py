"""Scores and findings: a row per provider and concept.

What counts as standing out is this library's own choice and is stated in one
table, ``RULES``. A finding's severity follows from its score alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.numbers import ratio, rounded
from claimspark.functions.periods import Providers, Tables, add_days, add_months, claims_in
from claimspark.functions.scratch import build_all, materialise
from claimspark.operators.claims import (
    VISIT_CODES,
    claims_above_limit,
    duplicate_claims,
    visit_code_mix,
)
from claimspark.operators.eligibility import coverage_gap_claims, retroactive_eligibility
from claimspark.operators.member import doctor_shopping_by_provider, member_utilization_spike
from claimspark.operators.network import referral_concentration, shared_patients
from claimspark.operators.provider import provider_peer_comparison, specialty_mismatch_totals
from claimspark.operators.signals import ramp_up, weekend_share
from claimspark.operators.temporal import billing_spike_detection
from claimspark.plans.registry import CONCEPTS

# The allowed finding types and severities.
FINDING_TYPES = ("anomaly", "pattern", "outlier", "correlation", "info")
SEVERITIES = ("critical", "high", "medium", "low", "info")

# Weight of a severity: a finding's confidence, and its part in the risk score.
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25, "info": 0.0}

@dataclass(frozen=True)
class Rule:
    """A score, not rounded, above a bound has that severity; at or below ``low`` there is no finding.

    Equal bounds leave a severity out: a concept that lists rows only above a bound
    of its own has nothing between the lower ones.
    """

    finding_type: str
    title: str
    measure: str
    critical: float
    high: float
    medium: float
    low: float


RULES: dict[str, Rule] = {
    "high_cost_claims": Rule("outlier", "Claims far above the usual cost", "highest cost ratio", 3, 2, 1.5, 1),
    "upcoding_pattern": Rule(
        "pattern", "More high-level visits than peers",
        "percentage points above peers on the two highest codes", 30, 20, 10, 5,
    ),
    "duplicate_claims": Rule("anomaly", "Duplicate claims", "most copies of one claim", 5, 3, 2, 1),
    "claim_volume_by_period": Rule(
        "pattern", "Sudden ramp-up of billing", "largest ratio to the month before", 10, 5, 3, 2
    ),
    "provider_peer_comparison": Rule("outlier", "Billing far above peers", "larger z-score", 3, 2, 2, 2),
    "provider_specialty_mismatch": Rule("anomaly", "Procedures outside the specialty", "claims", 100, 50, 10, 0),
    "doctor_shopping": Rule("pattern", "Members shopping for doctors", "most providers in 30 days", 8, 6, 5, 3),
    "member_utilization_spike": Rule(
        "anomaly", "Members with sudden use", "largest ratio to usual use", 10, 7, 5, 3
    ),
    "coverage_gap_claims": Rule("anomaly", "Claims without coverage", "claims", 100, 50, 10, 0),
    "retroactive_eligibility": Rule("anomaly", "Coverage recorded late", "most days late", 90, 60, 45, 30),
    "billing_spike_detection": Rule("outlier", "Billing spike", "largest z-score", 3, 2, 2, 2),
    "weekend_billing": Rule(
        "pattern", "More weekend billing than peers", "percentage points above peers", 30, 20, 10, 5
    ),
    "referral_network": Rule(
        "pattern", "One referrer dominates", "share of the top referrer", 0.9, 0.75, 0.5, 0.5
    ),
    "shared_patients": Rule(
        "correlation", "Patients shared with other providers", "most shared members", 20, 10, 5, 2
    ),
}


def _by_copies(claims: DataFrame) -> DataFrame:
    """Claims that agree on provider, member, procedure and day as one row: how many, their sum, the costliest."""
    return claims.groupBy("provider_npi", "member_id", "procedure_code", "service_date").agg(
        F.count("*").alias("claims"),
        F.sum("allowed_amount").alias("total_allowed"),
        F.max("allowed_amount").alias("dearest_copy"),
    )


def _score(
    concept: str,
    rows: DataFrame,
    score: Column,
    amount: Column | None = None,
    recoverable: Column | None = None,
    certain: Column | None = None,
    row_count: Column | None = None,
) -> DataFrame:
    """One row per provider in a shape common to all concepts."""
    zero = F.lit(0.0)
    number = lambda c: zero if c is None else F.coalesce(c.cast("double"), zero)
    return rows.groupBy("provider_npi").agg(
        F.lit(concept).alias("concept"),
        (F.count("*") if row_count is None else row_count).alias("row_count"),
        score.cast("double").alias("score"),
        number(amount).alias("amount"),
        number(recoverable).alias("recoverable"),
        number(certain).alias("certain"),
    )


#: What scores read of a claim, and how far around the period: months back, days ahead.
CLAIM_COLUMNS = (
    "claim_id", "provider_npi", "member_id", "referring_npi", "service_date", "procedure_code",
    "diagnosis_code", "service_state", "allowed_amount",
)
MONTHS_BACK, DAYS_AHEAD = 24, 7
#: So many concepts are worth a copy of the period's claims; fewer read the claims themselves.
COPY_FROM = 5


def stored_period(tables: Tables, start: date | str, end: date | str, months: int, days: int) -> dict[str, DataFrame]:
    """The tables with the claims of the period and around it written once, for plans that read them often.

    The claims themselves are then read once, whatever the number of concepts. Columns
    that no score needs are left out.
    """
    near = claims_in(tables, add_months(start, -months), add_days(end, days))
    return {**tables, "claims": materialise(near.select(*CLAIM_COLUMNS), "period-claims")}


def provider_scores(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    codes: tuple[str, ...] = VISIT_CODES,
    concepts: Iterable[str] | None = None,
    options: Mapping[str, Mapping[str, object]] | None = None,
) -> DataFrame:
    """Score of every provider for every concept that has rows for it.

    (provider_npi, concept, row_count, score, amount, recoverable, certain):
    ``amount`` is the money involved, ``recoverable`` the estimated overpayment and
    ``certain`` the part of it that needs no judgement (the costliest copy of a
    duplicate is not in it; of copies without coverage only the costliest is, so that
    the certain parts of both can be added). Scores are not rounded. ``concepts`` limits the work to some of them and
    ``options`` are passed to the operators by name.

    The table has at most one row per provider and concept however many claims
    there are. Findings, estimates, risk and reports all derive from it, so it is
    worth storing once; the branches are independent and run side by side. Many concepts
    read a copy of the period's claims that is stored first, so the claims are scanned
    once; fewer than ``COPY_FROM`` read the claims.
    """
    given = options or {}
    months = max([MONTHS_BACK, *(own.get("lookback_months", 0) for own in given.values())])
    days = max([DAYS_AHEAD, *(own.get("days", 0) for own in given.values())])
    if concepts is not None:
        concepts = list(concepts)
    if concepts is None or len(concepts) >= COPY_FROM:
        tables = stored_period(tables, start, end, max(months, days // 28 + 1), days)

    def rows(operator, **extra) -> DataFrame:
        return operator(tables, start, end, providers, **{**extra, **given.get(operator.__name__, {})})

    allowed, total = F.sum("allowed_amount"), F.sum("total_allowed")
    excess = F.col("claims") - F.col("peer_pct") / 100 * F.col("provider_total")
    price = F.col("peer_allowed").cast("double") / F.col("peer_claims")
    above = F.when(F.col("procedure_code").isin(*codes[-2:]), F.col("provider_pct") - F.col("peer_pct"))
    mismatched = F.sum("claims")

    # Per concept: the operator's rows, score, amount, recoverable, certain, row count.
    measures: dict[str, Callable[[], tuple]] = {
        "high_cost_claims": lambda: (
            rows(claims_above_limit),
            F.max(ratio(F.col("allowed_amount"), F.col("p95"))), allowed,
        ),
        "upcoding_pattern": lambda: (
            rows(visit_code_mix, codes=codes),
            F.coalesce(F.sum(above), F.lit(0.0)), F.sum("allowed"),
            F.greatest(rounded(F.sum(excess * price), 2), F.lit(0.0)),
        ),
        "duplicate_claims": lambda: (
            rows(duplicate_claims, dearest=True), F.max("claim_count"), total, total,
            F.sum(F.col("total_allowed") - F.col("dearest_copy")),
        ),
        "claim_volume_by_period": lambda: (rows(ramp_up, exact=True), F.max("ramp_ratio"), total),
        "provider_peer_comparison": lambda: (
            rows(provider_peer_comparison, exact=True), F.max(F.greatest("z_claims", "z_allowed")), total,
        ),
        "provider_specialty_mismatch": lambda: (
            rows(specialty_mismatch_totals), mismatched, total, None, None, mismatched,
        ),
        "doctor_shopping": lambda: (
            rows(doctor_shopping_by_provider), F.max("provider_count_30d"), total,
        ),
        "member_utilization_spike": lambda: (
            rows(member_utilization_spike, exact=True).where("spike_ratio is not null"), F.max("spike_ratio"),
        ),
        "coverage_gap_claims": lambda: (
            _by_copies(rows(coverage_gap_claims)), F.sum("claims"), total, total, F.sum("dearest_copy"), F.sum("claims"),
        ),
        "retroactive_eligibility": lambda: (
            rows(retroactive_eligibility), F.max("days_retroactive"), total,
        ),
        "billing_spike_detection": lambda: (
            rows(billing_spike_detection, exact=True), F.max("z_score"), total,
        ),
        "weekend_billing": lambda: (rows(weekend_share, exact=True), F.max("difference"), F.sum("weekend_allowed")),
        "referral_network": lambda: (rows(referral_concentration, exact=True), F.max("top_share")),
        "shared_patients": lambda: (rows(shared_patients), F.max("shared_patients")),
    }
    chosen = measures if concepts is None else {name: measures[name] for name in concepts}
    builders = {
        name: (lambda n=name, make=make: _score(n, *make())) for name, make in chosen.items()
    }
    return reduce(DataFrame.union, build_all(tables["claims"].sparkSession, builders).values())


def _by_concept(values: Mapping[str, object]) -> Column:
    """The value listed for the row's concept."""
    pairs = [F.lit(item) for pair in values.items() for item in pair]
    return F.create_map(*pairs)[F.col("concept")]


def _bound(name: str) -> Column:
    return _by_concept({concept: float(getattr(rule, name)) for concept, rule in RULES.items()})


def _text(name: str) -> Column:
    return _by_concept({concept: getattr(rule, name) for concept, rule in RULES.items()})


def findings(scores: DataFrame) -> DataFrame:
    """(provider_npi, domain, concept, finding_type, severity, title, explanation,
    metrics, evidence, amount, recoverable, confidence) for the scores that stand out.
    """
    score = F.col("score")
    severity = (
        F.when(score > _bound("critical"), "critical")
        .when(score > _bound("high"), "high")
        .when(score > _bound("medium"), "medium")
        .when(score > _bound("low"), "low")
    )
    metrics = [
        part
        for name in ("row_count", "score", "amount", "recoverable")
        for part in (F.lit(name), rounded(score, 4) if name == "score" else F.col(name).cast("double"))
    ]
    weights = F.create_map(*[F.lit(item) for pair in SEVERITY_WEIGHT.items() for item in pair])
    return (
        scores.withColumn("severity", severity)
        .where("severity is not null")
        .select(
            "provider_npi",
            _by_concept({name: concept.domain for name, concept in CONCEPTS.items()}).alias("domain"),
            "concept",
            _text("finding_type").alias("finding_type"),
            "severity",
            _text("title").alias("title"),
            F.format_string("%s: %d rows", _text("title"), F.col("row_count")).alias("explanation"),
            F.create_map(*metrics).alias("metrics"),
            F.create_map(F.lit("measure"), _text("measure")).alias("evidence"),
            "amount",
            "recoverable",
            weights[F.col("severity")].alias("confidence"),
        )
    )


def invalid_findings(found: DataFrame) -> DataFrame:
    """Rows with a finding type or severity that is not allowed."""
    return found.where(
        ~F.coalesce(F.col("finding_type").isin(*FINDING_TYPES), F.lit(False))
        | ~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
    )


def hypothesis_status(
    hypotheses: DataFrame, found: DataFrame, *, supported: float = 0.6, refuted: float = 0.3
) -> DataFrame:
    """Status of each (hypothesis_id, provider_npi, concept) by the finding's confidence.

    Above ``supported`` it is supported, below ``refuted`` refuted, otherwise open.
    No finding counts as confidence zero.
    """
    best = found.groupBy("provider_npi", "concept").agg(F.max("confidence").alias("_confidence"))
    confidence = F.coalesce("_confidence", F.lit(0.0))
    return hypotheses.join(best, ["provider_npi", "concept"], "left").select(
        "hypothesis_id", "provider_npi", "concept",
        confidence.alias("confidence"),
        F.when(confidence > supported, "supported").when(confidence < refuted, "refuted")
        .otherwise("open").alias("status"),
    )
