"""Claims domain: cost outliers, code mix, duplicates, monthly volume."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import ratio, rounded
from claimspark.functions.percentiles import exact_percentile, percentile_by_brackets
from claimspark.functions.periods import Providers, Tables, claim_count, claims_in, keep_providers, month_of, priced_count

# The evaluation-and-management visit codes, lowest level first.
VISIT_CODES = ("99211", "99212", "99213", "99214", "99215")


def claims_above_limit(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    fraction: str | float = "0.95",
    brackets: bool = False,
) -> DataFrame:
    """Claims with ``p95``, the percentile of their procedure and state, that exceed it.

    ``brackets`` finds the same percentile by one reading more and far fewer shuffled values,
    for groups of very many distinct amounts.

    The percentile is over all providers' claims in the period. Claims without a
    procedure or a state have none and drop out.
    """
    keys = ["procedure_code", "service_state"]
    claims = claims_in(tables, start, end).dropna(subset=keys)
    percentile = percentile_by_brackets if brackets else exact_percentile
    limits = percentile(claims, keys, "allowed_amount", fraction, "p95")
    return keep_providers(claims, providers).join(limits, keys).where(F.col("allowed_amount") > F.col("p95"))


def high_cost_claims(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    fraction: str | float = "0.95",
    brackets: bool = False,
) -> DataFrame:
    """Claims above the percentile of their procedure and state, with the ratio to it."""
    return claims_above_limit(tables, start, end, providers, fraction=fraction, brackets=brackets).select(
        "claim_id", "provider_npi", "member_id", "procedure_code", "allowed_amount",
        F.col("p95").cast("double").alias("p95"),
        rounded(ratio(F.col("allowed_amount"), F.col("p95")), 2).alias("cost_ratio"),
    )


def visit_code_counts(
    tables: Tables, start: date | str, end: date | str, codes: tuple[str, ...] = VISIT_CODES
) -> DataFrame:
    """Claims and allowed amount per (provider, visit code)."""
    return (
        claims_in(tables, start, end)
        .where(F.col("procedure_code").isin(*codes))
        .groupBy("provider_npi", "procedure_code")
        .agg(F.count("*").alias("claims"), F.sum("allowed_amount").alias("allowed"))
    )


def visit_code_mix(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    codes: tuple[str, ...] = VISIT_CODES,
    exclude_self: bool = False,
) -> DataFrame:
    """Unrounded code shares of each provider and of its specialty.

    Claims are counted per (provider, code) before any join, so joins and windows
    see at most one row per provider and code.
    """
    counts = visit_code_counts(tables, start, end, codes)
    specialties = tables["providers"].select(F.col("npi").alias("provider_npi"), "specialty")
    counted = counts.join(specialties.where(F.col("specialty").isNotNull()), "provider_npi")
    peers = counted.groupBy("specialty", "procedure_code").agg(
        F.sum("claims").alias("peer_claims"), F.sum("allowed").alias("peer_allowed")
    ).withColumn("peer_total", F.sum("peer_claims").over(Window.partitionBy("specialty")))
    own = counted.withColumn(
        "provider_total", F.sum("claims").over(Window.partitionBy("provider_npi"))
    )
    mix = keep_providers(own, providers).join(peers, ["specialty", "procedure_code"])
    if exclude_self:
        mix = (
            mix.withColumn("peer_claims", F.col("peer_claims") - F.col("claims"))
            .withColumn("peer_total", F.col("peer_total") - F.col("provider_total"))
            .withColumn("peer_allowed", F.col("peer_allowed") - F.col("allowed"))
        )
    return mix.withColumn(
        "provider_pct", F.col("claims") * 100.0 / F.col("provider_total")
    ).withColumn("peer_pct", ratio(F.col("peer_claims") * 100.0, F.col("peer_total")))


def upcoding_pattern(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    codes: tuple[str, ...] = VISIT_CODES,
    exclude_self: bool = False,
) -> DataFrame:
    """Share of each visit code for the provider and its specialty, in percent.

    The specialty includes the provider unless ``exclude_self`` is set.
    """
    mix = visit_code_mix(tables, start, end, providers, codes=codes, exclude_self=exclude_self)
    return mix.select(
        "provider_npi", "procedure_code",
        rounded(F.col("provider_pct"), 1).alias("provider_pct"),
        rounded(F.col("peer_pct"), 1).alias("peer_pct"),
        rounded(F.col("provider_pct") - F.col("peer_pct"), 1).alias("delta"),
    )


def duplicates(df: DataFrame, keys: list[str], amount: str, *, dearest: bool = False) -> DataFrame:
    """Groups of two or more rows that agree on ``keys``."""
    measures = [F.count("*").alias("claim_count"), F.sum(amount).alias("total_allowed")]
    if dearest:
        measures.append(F.max(amount).alias("dearest_copy"))
    return df.groupBy(*keys).agg(*measures).where("claim_count > 1")


def duplicate_claims(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    dearest: bool = False,
) -> DataFrame:
    """Same provider, member, procedure and service date more than once.

    ``dearest`` adds the amount of each group's costliest claim.
    """
    claims = keep_providers(claims_in(tables, start, end), providers)
    keys = ["provider_npi", "member_id", "procedure_code", "service_date"]
    return duplicates(claims, keys, "allowed_amount", dearest=dearest)


def claim_volume_by_period(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """Monthly claim count, allowed sum and average per provider."""
    claims = keep_providers(claims_in(tables, start, end), providers)
    return (
        claims.groupBy("provider_npi", month_of("service_date").alias("month"))
        .agg(
            claim_count(claims).alias("claim_count"),
            F.sum("allowed_amount").alias("total_allowed"),
            priced_count(claims).alias("_priced"),
        )
        .withColumn("avg_allowed", rounded(ratio(F.col("total_allowed"), F.col("_priced")), 4))
        .drop("_priced")
    )
