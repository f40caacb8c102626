"""Temporal domain: billing spikes and weekday profile."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.numbers import ratio, rounded
from claimspark.functions.periods import Providers, Tables, add_months, as_date, claim_count, claims_in, keep_providers, month_of

# Day names, counted from Sunday = 0.
DAY_NAMES = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")


def billing_spike_detection(
    tables: Tables,
    start: date | str,
    end: date | str,
    providers: Providers = None,
    *,
    min_z: float = 2.0,
    months: int = 12,
    lookback_months: int = 24,
    exact: bool = False,
) -> DataFrame:
    """Months whose allowed sum is over ``min_z`` deviations above the earlier mean.

    The score is rounded for display unless ``exact`` is set.

    Mean and sample deviation are over up to ``months`` earlier active months, with
    history from ``lookback_months`` before the start. Fewer than two earlier
    months, or months without spread, give no score and no row. A period that
    starts within a month leaves that month out.
    """
    claims = keep_providers(claims_in(tables, add_months(start, -lookback_months), end), providers)
    monthly = claims.groupBy("provider_npi", month_of("service_date").alias("month")).agg(
        claim_count(claims).alias("claims"), F.sum("allowed_amount").alias("total_allowed")
    )
    earlier = Window.partitionBy("provider_npi").orderBy("month").rowsBetween(-months, -1)
    total = F.col("total_allowed").cast("double")
    return (
        monthly.withColumn("_mean", F.avg(total).over(earlier))
        .withColumn("_std", F.stddev_samp(total).over(earlier))
        .withColumn("_z", ratio(total - F.col("_mean"), F.col("_std")))
        .where((F.col("month") >= F.lit(as_date(start))) & (F.col("_z") > min_z))
        .select(
            "provider_npi", "month", "claims", "total_allowed",
            rounded(F.col("_mean"), 2).alias("rolling_avg"),
            rounded(F.col("_std"), 2).alias("rolling_std"),
            (F.col("_z") if exact else rounded(F.col("_z"), 2)).alias("z_score"),
        )
    )


def day_number(column: str) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(column) - 1


def weekend_billing(
    tables: Tables, start: date | str, end: date | str, providers: Providers = None
) -> DataFrame:
    """Claims and allowed amount per provider and day of week."""
    names = F.array(*[F.lit(name) for name in DAY_NAMES])
    claims = keep_providers(claims_in(tables, start, end), providers)
    return (
        claims.groupBy("provider_npi", day_number("service_date").alias("dow"))
        .agg(claim_count(claims).alias("claim_count"), F.sum("allowed_amount").alias("total_allowed"))
        .select("provider_npi", "dow", names[F.col("dow")].alias("day_name"), "claim_count", "total_allowed")
    )
