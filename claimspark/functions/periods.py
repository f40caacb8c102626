"""Period and provider filters common to all operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
Providers = DataFrame | Iterable[str] | str | None


def as_date(value: date | str) -> date:
    """Accept a date or an ISO string; anything else raises ``ValueError``."""
    return value if isinstance(value, date) else date.fromisoformat(value)


def add_months(value: date | str, months: int) -> date:
    """Calendar arithmetic on the driver, so that filters reach the scan as literals."""
    day = as_date(value)
    index = day.year * 12 + day.month - 1 + months
    year, month = divmod(index, 12)
    following = date(year + (month + 1) // 12, (month + 1) % 12 + 1, 1)
    last = date.fromordinal(following.toordinal() - 1).day
    return date(year, month + 1, min(day.day, last))


def add_days(value: date | str, days: int) -> date:
    return date.fromordinal(as_date(value).toordinal() + days)


def between_dates(column: Column, start: date | str, end: date | str) -> Column:
    return column.between(F.lit(as_date(start)), F.lit(as_date(end)))


def claims_in(tables: Tables, start: date | str, end: date | str) -> DataFrame:
    """Claims with a service date in the period, both ends included."""
    return tables["claims"].where(between_dates(F.col("service_date"), start, end))


def with_claims(tables: Tables, condition: Column) -> dict[str, DataFrame]:
    """The tables with only the claims that meet ``condition``, a ``claim_status`` for example."""
    return {**tables, "claims": tables["claims"].where(condition)}


def keep_providers(df: DataFrame, providers: Providers, column: str = "provider_npi") -> DataFrame:
    """Keep rows of the wanted providers; ``None`` keeps all.

    Names given as strings become a literal filter that the scan can use; a
    DataFrame (column ``provider_npi`` or ``npi``) becomes a semi join.
    """
    if providers is None:
        return df
    if isinstance(providers, str):
        return df.where(F.col(column) == providers)
    if isinstance(providers, DataFrame):
        name = "provider_npi" if "provider_npi" in providers.columns else "npi"
        wanted = providers.select(F.col(name).alias(column)).distinct()
        return df.join(wanted, column, "left_semi")
    return df.where(F.col(column).isin(list(providers)))


def month_of(column: str) -> Column:
    return F.trunc(F.col(column), "month")


#: In a claims table that holds sums instead of single claims: how many it stands for, and how many of them have an amount.
CLAIMS, PRICED = "claims_summed", "claims_priced"


def claim_count(claims: DataFrame) -> Column:
    """The aggregate that counts claims, whether a row is one or a sum of several."""
    return F.sum(CLAIMS) if CLAIMS in claims.columns else F.count("*")


def priced_count(claims: DataFrame) -> Column:
    """The aggregate that counts claims with an amount."""
    return F.sum(PRICED) if PRICED in claims.columns else F.count("allowed_amount")
