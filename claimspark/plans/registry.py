"""Named concepts: what each computes, its parameters, and how to run it."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import DataFrame

from claimspark.functions.periods import Providers, Tables
from claimspark.functions.scratch import materialise_all
from claimspark.operators import claims, eligibility, member, network, provider, temporal
from claimspark.operators.quality import ROW_LIMIT, sort_columns, top_rows, validate_result

PARAMETERS = ("provider_npi", "start_date", "end_date")
# Links shown for one provider.
DISPLAY_TOP = {"referral_network": 50, "shared_patients": 30}


@dataclass(frozen=True)
class Concept:
    """A named query.

    ``order`` sorts one provider's result for display; a minus sign before a
    column means largest first. ``sample`` rows go into an evidence pack.
    """

    name: str
    description: str
    domain: str
    operator: Callable[..., DataFrame]
    order: tuple[str, ...]
    sample: int = 20
    parameters: tuple[str, ...] = PARAMETERS


def _concepts() -> Iterator[Concept]:
    yield Concept(
        "high_cost_claims",
        "Claims with an allowed amount above the 95th percentile of their procedure and state",
        "claims", claims.high_cost_claims, ("-cost_ratio", "claim_id"),
    )
    yield Concept(
        "upcoding_pattern",
        "Visit code shares of the provider against its specialty",
        "claims", claims.upcoding_pattern, ("procedure_code",),
    )
    yield Concept(
        "duplicate_claims",
        "Claims that agree on provider, member, procedure and service date",
        "claims", claims.duplicate_claims,
        ("-claim_count", "member_id", "procedure_code", "service_date"),
    )
    yield Concept(
        "claim_volume_by_period",
        "Claims and allowed amounts per month",
        "claims", claims.claim_volume_by_period, ("month",),
    )
    yield Concept(
        "provider_peer_comparison",
        "Billing totals with z-scores against the same specialty and state",
        "provider", provider.provider_peer_comparison, ("provider_npi",),
    )
    yield Concept(
        "provider_specialty_mismatch",
        "Claims for procedures outside the provider's specialty",
        "provider", provider.provider_specialty_mismatch,
        ("-allowed_amount", "service_date", "procedure_code", "procedure_specialty"),
    )
    yield Concept(
        "doctor_shopping",
        "Members who saw four or more providers for one diagnosis within 30 days",
        "member", member.doctor_shopping,
        ("-provider_count_30d", "member_id", "diagnosis_code"),
    )
    yield Concept(
        "member_utilization_spike",
        "Members with over three times their usual monthly claims",
        "member", member.member_utilization_spike,
        ("-spike_ratio", "member_id", "month"),
    )
    yield Concept(
        "coverage_gap_claims",
        "Claims on days without coverage",
        "eligibility", eligibility.coverage_gap_claims, ("-allowed_amount", "claim_id"),
    )
    yield Concept(
        "retroactive_eligibility",
        "Coverage recorded over 30 days after its start, with the claims inside it",
        "eligibility", eligibility.retroactive_eligibility,
        ("-days_retroactive", "member_id", "coverage_start", "coverage_end", "created_date"),
    )
    yield Concept(
        "billing_spike_detection",
        "Months billed over two standard deviations above the preceding months",
        "temporal", temporal.billing_spike_detection, ("-z_score", "month"), 30,
    )
    yield Concept(
        "weekend_billing",
        "Claims and allowed amounts per day of the week",
        "temporal", temporal.weekend_billing, ("dow",), 30,
    )
    yield Concept(
        "referral_network",
        "Strongest referral links from and to the provider",
        "network", network.referral_network,
        ("-referral_count", "referring_npi", "rendering_npi"),
    )
    yield Concept(
        "shared_patients",
        "Providers who saw the same members within a week",
        "network", network.shared_patients, ("-shared_patients", "other_provider"),
    )


CONCEPTS: dict[str, Concept] = {concept.name: concept for concept in _concepts()}


def get_concept(name: str) -> Concept | None:
    return CONCEPTS.get(name)


def get_concepts_for_domain(domain: str) -> list[Concept]:
    return [concept for concept in CONCEPTS.values() if concept.domain == domain]


def list_concepts(domain: str | None = None) -> list[dict[str, object]]:
    """Name, description, domain and parameters of the concepts, of one domain if given."""
    chosen = CONCEPTS.values() if domain is None else get_concepts_for_domain(domain)
    return [
        {
            "name": concept.name,
            "description": concept.description,
            "domain": concept.domain,
            "parameters": list(concept.parameters),
        }
        for concept in chosen
    ]


def _checked(name: str, params: Mapping[str, object], required: tuple[str, ...]) -> Concept:
    concept = get_concept(name)
    if concept is None:
        raise ValueError(f"Unknown semantic concept: {name}")
    missing = [p for p in concept.parameters if p in required and p not in params]
    if missing:
        raise ValueError(f"Missing parameters for {name}: {missing}")
    return concept


def run(
    name: str, tables: Tables, params: Mapping[str, object], *, limit: int | None = ROW_LIMIT, **options
) -> DataFrame:
    """One provider's result, in display order; ``limit`` rows at most, all of them with ``None``.

    The network concepts show as many links as ``DISPLAY_TOP`` says unless ``top`` is given.
    """
    concept = _checked(name, params, PARAMETERS)
    shown = {"top": DISPLAY_TOP[name]} if name in DISPLAY_TOP else {}
    result = concept.operator(
        tables, params["start_date"], params["end_date"], params["provider_npi"], **{**shown, **options}
    )
    return top_rows(result, sort_columns(concept.order), limit)


def run_validated(
    name: str, tables: Tables, params: Mapping[str, object], **options
) -> tuple[DataFrame, DataFrame]:
    """``run`` with personal data masked, and the warnings about the result."""
    return validate_result(run(name, tables, params, **options))


def sweep(
    name: str,
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    **options,
) -> DataFrame:
    """The result for all providers, or the given ones: unordered and uncapped."""
    concept = _checked(name, {}, ())
    return concept.operator(tables, start, end, providers, **options)


def sweep_all(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    options: Mapping[str, Mapping[str, object]] | None = None,
    operators: Mapping[str, Callable[..., DataFrame]] | None = None,
) -> dict[str, DataFrame]:
    """Results of all concepts, written to shared storage by concurrent jobs.

    ``options`` are passed to the operators by concept name; ``operators`` replaces
    the operator of a concept.
    """
    chosen = {c.name: c.operator for c in CONCEPTS.values()} | dict(operators or {})
    builders = {
        name: partial(operator, tables, start, end, providers, **(options or {}).get(name, {}))
        for name, operator in chosen.items()
    }
    return materialise_all(tables["claims"].sparkSession, builders)
