"""Parquet layout: claims clustered by provider and date, or by provider and member alike; eligibility by member."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.periods import as_date, between_dates

#: Rows that cuts of a key are taken from, about; any cuts give right results.
CUT_SAMPLE = 16_384


def _write_clustered(df: DataFrame, path: str, partition: str, order: list[str], files: int | None) -> None:
    # Ranges end with the row's own key, so a provider with a third of all claims
    # is cut into as many files as its volume asks for.
    columns = [partition, *order]
    ranged = df.repartitionByRange(files, *columns) if files else df.repartitionByRange(*columns)
    ranged.sortWithinPartitions(*columns).write.mode("errorifexists").partitionBy(partition).parquet(path)


def write_claims(claims: DataFrame, path: str, files: int | None = None) -> None:
    """Write claims partitioned by service month, sorted by provider and date.

    Sorted files have narrow minimum and maximum statistics per row group, so a
    filter on a provider skips most of a month.
    """
    _write_clustered(
        claims.withColumn("service_month", F.trunc("service_date", "month")),
        path, "service_month", ["provider_npi", "service_date", "claim_id"], files,
    )


def interleaved(ranks: list[Column], bits: int) -> Column:
    """One number from several of ``bits`` bits each: their bits in turn, highest first (Morton order)."""
    number = F.lit(0).cast("long")
    for bit in range(bits):
        for at, rank in enumerate(reversed(ranks)):
            one = F.shiftright(rank.cast("long"), bit).bitwiseAND(F.lit(1).cast("long"))
            number = number.bitwiseOR(F.shiftleft(one, bit * len(ranks) + at))
    return number


def _rank(column: str, cuts: list) -> Column:
    """How many cuts are not above the value; null comes first."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(cut) for cut in cuts]), lambda cut: cut <= F.col(column)))


def _cuts(df: DataFrame, columns: list[str], count: int) -> dict[str, list]:
    """At most ``count`` ascending values of each column that cut its rows into about equal parts.

    A value that is in very many rows is one cut and so has a part of its own.
    """
    total = df.count()
    drawn = df.select(*columns).sample(min(1.0, CUT_SAMPLE / max(total, 1)), seed=7).collect()
    cuts = {}
    for column in columns:
        values = sorted(row[column] for row in drawn if row[column] is not None)
        cuts[column] = sorted({values[len(values) * n // (count + 1)] for n in range(1, count + 1)}) if values else []
    return cuts


def write_claims_interleaved(claims: DataFrame, path: str, files: int | None = None, *, bits: int = 7) -> None:
    """Write claims partitioned by service month, in the Morton order of provider and member.

    Each key is cut into at most 2 ** ``bits`` ranges of about equal rows. A stretch of the file
    is then a rectangle of the two keys, so that filters on a provider and filters on a
    member both skip: of n row groups or pages of a month about the square root of n are read.
    ``write_claims`` reads less for a provider and all of a month for a member. Equal places
    are sorted by the row's own key, so a key with a third of all claims is cut by the other
    key and into as many files as its volume asks for. ``read_claims`` reads both layouts.
    """
    if not 1 <= bits <= 12:
        raise ValueError("a key is cut by 1 to 12 bits")
    keys = ["provider_npi", "member_id"]
    cuts = _cuts(claims, keys, 2**bits - 1)
    place = interleaved([_rank(key, cuts[key]) for key in keys], bits)
    placed = claims.withColumns({"service_month": F.trunc("service_date", "month"), "_place": place})
    order = ["service_month", "_place", *keys, "service_date", "claim_id"]
    ranged = placed.repartitionByRange(files, *order) if files else placed.repartitionByRange(*order)
    # the month leads the order, so the writer needs no sort of its own, which would undo this one
    ranged.sortWithinPartitions(*order).drop("_place").write.mode("errorifexists").partitionBy("service_month").parquet(path)


def read_claims(
    spark: SparkSession, path: str, start: date | str | None = None, end: date | str | None = None
) -> DataFrame:
    """Read claims written by ``write_claims``; bounds prune whole months.

    A date filter alone does not prune partitions, because Spark cannot infer the
    month from it, so the month filter is added here. Without both bounds all
    rows are read, those without a service date included.
    """
    claims = spark.read.parquet(path)
    if start is not None and end is not None:
        months = F.col("service_month").between(F.lit(as_date(start).replace(day=1)), F.lit(as_date(end)))
        claims = claims.where(months & between_dates(F.col("service_date"), start, end))
    return claims.drop("service_month")


def write_eligibility(eligibility: DataFrame, path: str, files: int | None = None) -> None:
    """Write eligibility partitioned by coverage start year, sorted by member and start."""
    _write_clustered(
        eligibility.withColumn("start_year", F.year("coverage_start")),
        path, "start_year", ["member_id", "coverage_start", "eligibility_id"], files,
    )


def read_eligibility(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("start_year")
