"""Provider domain: peer z-scores and procedures outside the specialty."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.numbers import ratio, rounded
from claimspark.functions.periods import Providers, Tables, claim_count, claims_in, keep_providers, priced_count


def provider_totals(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """Claims, allowed sum and average, and distinct patients per provider."""
    claims = claims_in(tables, start, end)
    return (
        claims.groupBy("provider_npi")
        .agg(
            claim_count(claims).alias("total_claims"),
            F.sum("allowed_amount").alias("total_allowed"),
            priced_count(claims).alias("_priced"),
            F.count_distinct("member_id").alias("unique_patients"),
        )
        .withColumn("avg_allowed", rounded(ratio(F.col("total_allowed"), F.col("_priced")), 4))
        .drop("_priced")
    )


def provider_peer_comparison(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    exclude_self: bool = False,
    exact: bool = False,
) -> DataFrame:
    """Provider totals with z-scores against the same specialty and state.

    Scores are rounded for display unless ``exact`` is set.

    The peer group includes the provider unless ``exclude_self`` is set, and only
    peers with claims in the period. A group without spread, or a provider without
    a group, has NULL scores. Group moments come from a combinable aggregate, not
    a window, so a very large group is never gathered in one task.
    """
    group = ["specialty", "practice_state"]
    places = tables["providers"].select(F.col("npi").alias("provider_npi"), *group)
    totals = provider_totals(tables, start, end).join(places, "provider_npi", "left")
    measures = {"claims": "total_claims", "allowed": "total_allowed"}
    moments = [F.count("*").alias("_peers")]
    for name, column in measures.items():
        value = F.col(column).cast("double")
        moments += [
            F.avg(value).alias(f"_mean_{name}"),
            F.stddev_samp(value).alias(f"_std_{name}"),
            F.var_pop(value).alias(f"_var_{name}"),
        ]
    peers = totals.dropna(subset=group).groupBy(*group).agg(*moments)
    scored = keep_providers(totals, providers).join(peers, group, "left")
    scores = []
    for name, column in measures.items():
        value, mean, std = F.col(column).cast("double"), F.col(f"_mean_{name}"), F.col(f"_std_{name}")
        if exclude_self:
            # Remove the provider's own value from the group's mean and variance.
            n = F.col("_peers")
            rest = ratio(n * mean - value, n - 1)
            squares = n * F.col(f"_var_{name}") - (value - mean) * (value - rest)
            mean, std = rest, F.sqrt(F.greatest(ratio(squares, n - 2), F.lit(0.0)))
        score = ratio(value - mean, std)
        scores.append((score if exact else rounded(score, 2)).alias(f"z_{name}"))
    return scored.select(
        "provider_npi", "total_claims", "total_allowed", "avg_allowed", "unique_patients", *scores
    )


def _with_mismatch(tables: Tables, claims: DataFrame, literal: bool) -> DataFrame:
    """Keep rows of (provider_npi, procedure_code, ...) whose procedure does not fit
    the provider's specialty, and add both specialties."""
    mapping = tables["specialty_procedure_map"].select("procedure_code", "expected_specialty").distinct()
    specialties = tables["providers"].select(
        F.col("npi").alias("provider_npi"), F.col("specialty").alias("provider_specialty")
    )
    if literal:
        mapped = mapping.withColumnRenamed("expected_specialty", "procedure_specialty")
        differs = F.col("provider_specialty") != F.col("procedure_specialty")
    else:
        # One row per procedure; the list is as short as the map's specialties.
        mapped = (
            mapping.dropna()
            .groupBy("procedure_code")
            .agg(F.sort_array(F.collect_set("expected_specialty")).alias("_expected"))
            .withColumn("procedure_specialty", F.array_join("_expected", "|"))
        )
        differs = ~F.array_contains("_expected", F.col("provider_specialty"))
    return claims.join(mapped, "procedure_code").join(specialties, "provider_npi").where(differs)


def provider_specialty_mismatch(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    literal: bool = False,
) -> DataFrame:
    """Claims for procedures that belong to another specialty than the provider's.

    By default a claim is listed once, when none of the specialties mapped to its
    procedure is the provider's; ``procedure_specialty`` then lists them. With
    ``literal`` there is one row per mapped specialty that differs, so a procedure
    shared by two specialties mismatches for both. Unmapped procedures never match.
    """
    claims = keep_providers(claims_in(tables, start, end), providers).select(
        "provider_npi", "procedure_code", "service_date", "allowed_amount"
    )
    return _with_mismatch(tables, claims, literal).select(
        "provider_npi", "procedure_code", "service_date", "allowed_amount",
        "provider_specialty", "procedure_specialty",
    )


def specialty_mismatch_totals(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """Mismatched claims and their allowed sum per provider and procedure.

    Claims are summed before the joins, so a provider with very many claims is a
    few rows in them.
    """
    totals = (
        keep_providers(claims_in(tables, start, end), providers)
        .groupBy("provider_npi", "procedure_code")
        .agg(F.count("*").alias("claims"), F.sum("allowed_amount").alias("total_allowed"))
    )
    return _with_mismatch(tables, totals, literal=False).select(
        "provider_npi", "procedure_code", "claims", "total_allowed",
        "provider_specialty", "procedure_specialty",
    )
