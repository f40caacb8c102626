"""Rounding and scale helpers that give the same digits on every engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(12,2)"


def rounded(value: Column, digits: int) -> Column:
    """Round half-up in decimal arithmetic, returned as double.

    Rounding the double itself can go either way on a tie that binary
    floating point cannot hold (1.005), so the value passes through a decimal
    with as many digits as doubles of up to a hundred million hold reliably.
    """
    return F.round(value.cast("decimal(38,8)"), digits).cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that gives NULL instead of an error on a zero divisor."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Cast decimal columns to double, for exchange with engines that differ in scale."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )
