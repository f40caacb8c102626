"""Point-in-span tests without comparing every point with every span."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.periods import as_date


def span_cover(
    points: DataFrame,
    spans: DataFrame,
    key: str,
    day: str,
    span_start: str,
    span_end: str,
    first: date | str,
    last: date | str,
) -> DataFrame:
    """Distinct (``key``, ``day``, ``covered``) of the points.

    A day is covered when some span of the same key starts on or before it and
    ends on or after it. Points and spans are combined to one row per (key, day)
    before anything is sorted, with spans clipped to ``[first, last]``, so even a
    key that holds a third of all rows has no more rows in the window than the
    period has days. A running maximum of span ends then answers every point.
    """
    lower, upper = F.lit(as_date(first)), F.lit(as_date(last))
    arrivals = spans.where(
        F.col(key).isNotNull() & (F.col(span_end) >= lower) & (F.col(span_start) <= upper)
    ).select(
        F.col(key),
        F.greatest(F.col(span_start), lower).alias(day),
        F.col(span_end).alias("_reach"),
        F.lit(False).alias("_point"),
    )
    visits = points.select(
        F.col(key), F.col(day), F.lit(None).cast("date").alias("_reach"), F.lit(True).alias("_point")
    )
    per_day = (
        visits.unionByName(arrivals)
        .groupBy(key, day)
        .agg(F.max("_reach").alias("_reach"), F.bool_or("_point").alias("_point"))
    )
    upto = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return (
        per_day.withColumn("covered", F.coalesce(F.max("_reach").over(upto) >= F.col(day), F.lit(False)))
        .where("_point")
        .select(key, day, "covered")
    )
