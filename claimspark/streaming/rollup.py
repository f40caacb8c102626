"""Sums of claims by provider, member and day, kept up to date by loads and retractions.

The rollup is a folder of partial sums, partitioned by month and load and sorted by day. A load
adds partial sums for its own days; partial sums of a day merge by addition, whichever load they
are from. A claim that is rejected later is taken off by a partial sum with the opposite sign.
So a load reads nothing and writes nothing but its own days, and no file is written twice.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions.periods import CLAIMS, PRICED, Tables, as_date, between_dates, month_of
from claimspark.sources.schemas import SCHEMAS
from claimspark.streaming.membership import BUCKET, LOAD

_SUMS = (
    "provider_npi string, member_id string, service_date date, claims long, priced long, allowed decimal(38,2), "
    "service_month date, load long"
)
_PARTS = ["service_month", "load"]


def create_rollup(spark: SparkSession, rollup: str) -> None:
    """An empty rollup, unless there is one."""
    spark.createDataFrame([], _SUMS).write.mode("ignore").partitionBy(*_PARTS).parquet(rollup)


def _partial_sums(spark: SparkSession, rollup: str) -> DataFrame:
    return spark.read.schema(_SUMS).parquet(rollup)


def _sums(claims: DataFrame, load: int, sign: int) -> DataFrame:
    """Partial sums of ``claims``, dealt out and sorted as they are written, by one shuffle."""
    one = F.lit(sign).cast("long")
    # ranges of days: a month is few files, a large one several, and a day's sums are neighbours;
    # all claims of a sum are in one range, so they are added up where they are written
    order = ["service_month", "service_date", "provider_npi", "member_id"]
    ranged = claims.select(month_of("service_date").alias("service_month"), *order[1:], "allowed_amount").repartitionByRange(*order)
    sums = ranged.groupBy(*order).agg(
        F.sum(one).alias("claims"),
        F.coalesce(F.sum(F.when(F.col("allowed_amount").isNotNull(), one)), F.lit(0)).alias("priced"),
        (F.coalesce(F.sum("allowed_amount"), F.lit(0)) * sign).cast("decimal(38,2)").alias("allowed"),
    )
    return sums.withColumn("load", F.lit(load).cast("long")).sortWithinPartitions(*order)


def _add(claims: DataFrame, rollup: str, load: int, sign: int) -> None:
    """Partial sums of ``claims`` as load ``load``; what the load has for these months is replaced, so it can be run again."""
    _sums(claims, load, sign).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PARTS).parquet(rollup)


def refresh(spark: SparkSession, target: str, rollup: str) -> list[int]:
    """Add the loads of a claims target (see ``ingest``) that the rollup does not have yet, and return them.

    Loads are compared by their numbers, which are names of folders: no claim of an earlier
    load is read. A run that breaks off is made good by the next, which writes the same
    partial sums again.
    """
    stored = T.StructType([*SCHEMAS["claims"].fields, T.StructField(BUCKET, T.IntegerType()), T.StructField(LOAD, T.IntegerType())])
    claims = spark.read.schema(stored).parquet(target)
    known = {row["load"] for row in _partial_sums(spark, rollup).select("load").distinct().collect()}
    fresh = sorted(row[LOAD] for row in claims.select(LOAD).distinct().collect() if row[LOAD] not in known)
    for load in fresh:
        _add(claims.where(F.col(LOAD) == load), rollup, load, 1)
    return fresh


def add_claims(claims: DataFrame, rollup: str, load: int) -> None:
    """Add claims that are stored elsewhere, as load ``load`` (0 or more)."""
    if load < 0:
        raise ValueError("numbers of loads are not negative")
    _add(claims, rollup, load, 1)


def retract(claims: DataFrame, rollup: str, number: int) -> None:
    """Take off claims that were added and are rejected now; ``number`` (1 or more) names the retraction."""
    if number < 1:
        raise ValueError("retractions are numbered from 1")
    _add(claims, rollup, -number, -1)


def summed_claims(spark: SparkSession, rollup: str, start: date | str | None = None, end: date | str | None = None) -> DataFrame:
    """The rollup as claims: a row for each provider, member and day that has claims.

    ``claims_summed`` and ``claims_priced`` say how many claims it stands for and how many of
    those have an amount; ``allowed_amount`` is their sum. With both bounds only the months
    between them are read.
    """
    keys = ["provider_npi", "member_id", "service_date"]
    sums = _partial_sums(spark, rollup)
    if start is not None and end is not None:
        months = F.col("service_month").between(F.lit(as_date(start).replace(day=1)), F.lit(as_date(end)))
        sums = sums.where(months & between_dates(F.col("service_date"), start, end))
    sums = sums.groupBy(*keys).agg(
        F.sum("claims").alias(CLAIMS), F.sum("priced").alias(PRICED), F.sum("allowed").cast("decimal(38,2)").alias("_allowed")
    )
    amount = F.when(F.col(PRICED) > 0, F.col("_allowed")).alias("allowed_amount")
    return sums.where(F.col(CLAIMS) > 0).select(*keys, CLAIMS, PRICED, amount)


def with_rollup(
    tables: Tables, spark: SparkSession, rollup: str, start: date | str | None = None, end: date | str | None = None
) -> dict[str, DataFrame]:
    """The tables with the rollup in place of the claims.

    ``claim_volume_by_period``, ``provider_peer_comparison``, ``member_utilization_spike``,
    ``billing_spike_detection``, ``weekend_billing``, ``weekend_share``, ``ramp_up``,
    ``seasonal_deviation`` and ``outlier_severity`` give the results that they give for the
    claims themselves. Concepts that need single claims do not run on it. Bounds, if any,
    must leave room for what a concept looks back to.
    """
    return {**{name: tables[name] for name in tables if name != "claims"}, "claims": summed_claims(spark, rollup, start, end)}
