"""Checks on results and tables: null profile, evidence samples, row cap, constraints."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.periods import Tables
from claimspark.functions.privacy import mask_pii
from claimspark.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS

# Limits and messages of the result checks.
ROW_LIMIT = 5_000
NULL_WARNING_PERCENT = 50
EMPTY_WARNING = "No results returned — concept may not apply to this entity"
NULL_WARNING = "Column '%s' is %d%% null — data may be incomplete"


def null_profile(df: DataFrame, warn_above: float = NULL_WARNING_PERCENT) -> DataFrame:
    """(column, row_count, null_pct, is_warning, warning) in one pass over ``df``."""
    counts = df.agg(
        F.count("*").alias("_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(df.columns)],
    )
    columns = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"_n{i}").alias("nulls")) for i, c in enumerate(df.columns)]
    )
    percent = F.col("c.nulls") * 100.0 / F.nullif(F.col("_rows"), F.lit(0))
    return (
        counts.select("_rows", F.explode(columns).alias("c"))
        .select(F.col("c.column").alias("column"), F.col("_rows").alias("row_count"), percent.alias("_pct"))
        .withColumn("is_warning", F.coalesce(F.col("_pct") > warn_above, F.lit(False)))
        .select(
            "column", "row_count",
            F.round(F.col("_pct").cast("decimal(18,6)"), 2).cast("double").alias("null_pct"),
            "is_warning",
            F.when(
                F.col("is_warning"),
                F.format_string(NULL_WARNING, F.col("column"), F.bround("_pct", 0).cast("int")),
            ).alias("warning"),
        )
    )


def validate_result(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(masked rows, warnings): what may be shown of a result and what to be wary of.

    An empty result is valid; its one warning says that nothing was returned.
    """
    profile = null_profile(df)
    empty = profile.where("row_count = 0").select(F.lit(EMPTY_WARNING).alias("warning")).limit(1)
    return mask_pii(df), profile.where("is_warning").select("warning").unionByName(empty)


def sort_columns(order: Iterable[str]) -> list[Column]:
    """Sort expressions for column names; a leading minus sign means largest first."""
    return [
        F.desc_nulls_last(name[1:]) if name.startswith("-") else F.asc_nulls_first(name) for name in order
    ]


def top_rows(df: DataFrame, order: list[str | Column], limit: int | None = ROW_LIMIT) -> DataFrame:
    """The first rows in ``order`` (all with ``None``), for display of one provider's result."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def _warnings(columns: list[str]) -> Column:
    """Warnings for a group counted in ``row_count`` and ``_n0``, ``_n1``, ... nulls of each column."""
    percent = lambda i: F.col(f"_n{i}") * 100.0 / F.col("row_count")
    texts = [
        F.when(percent(i) > NULL_WARNING_PERCENT, F.format_string(NULL_WARNING, F.lit(c), F.bround(percent(i), 0).cast("int")))
        for i, c in enumerate(columns)
    ]
    return F.array_compact(F.array(*texts))


def evidence_pack(
    results: Mapping[str, DataFrame],
    orders: Mapping[str, list[Column]],
    owner: str = "provider_npi",
    sample: int | Mapping[str, int] = 20,
    asked: DataFrame | None = None,
) -> DataFrame:
    """(concept, provider_npi, row_count, warnings, sample) over the named results.

    ``sample`` holds each provider's first rows as JSON, personal data masked
    before it is taken and numbers kept as numbers. ``warnings`` name the columns
    that are mostly null in the provider's rows. Providers in ``asked`` (column
    ``provider_npi``) for which a concept found nothing have a row with count 0, no
    sample and a warning that says so; others without rows have none.

    Counting and ranking are separate aggregates: the rank limit applies before the
    shuffle, so at most ``sample`` rows per provider leave an input partition.
    """
    packs = []
    for concept, result in results.items():
        size = sample[concept] if isinstance(sample, Mapping) else sample
        safe = mask_pii(result)
        fields = [c for c in safe.columns if c != owner]
        ranked = Window.partitionBy(owner).orderBy(*orders[concept])
        first = (
            safe.withColumn("_rank", F.row_number().over(ranked))
            .where(F.col("_rank") <= size)
            .select(owner, "_rank", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
            .groupBy(owner)
            .agg(F.sort_array(F.collect_list(F.struct("_rank", "record"))).alias("_ranked"))
            .select(owner, F.col("_ranked.record").alias("sample"))
        )
        counts = safe.groupBy(owner).agg(
            F.count("*").alias("row_count"),
            *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{i}") for i, c in enumerate(fields)],
        )
        counts = counts.select(owner, "row_count", _warnings(fields).alias("warnings"))
        pack = counts.join(first, owner)
        if asked is not None:
            wanted = asked.select(F.col("provider_npi").alias(owner)).distinct()
            nothing = wanted.join(counts, owner, "left_anti").select(
                owner,
                F.lit(0).cast("bigint").alias("row_count"),
                F.array(F.lit(EMPTY_WARNING)).alias("warnings"),
                F.array().cast("array<string>").alias("sample"),
            )
            pack = pack.unionByName(nothing)
        packs.append(pack.select(F.lit(concept).alias("concept"), owner, "row_count", "warnings", "sample"))
    return reduce(DataFrame.unionByName, packs)


def constraint_report(tables: Tables) -> DataFrame:
    """(constraint, table, columns, violations) for every primary and foreign key.

    A primary key is violated by each surplus row of a key and by null keys, a
    foreign key by each row whose value is not in the parent table. Child values
    are counted before the anti join, so a frequent orphan is one row in it.
    """
    checks = []
    for table, keys in PRIMARY_KEYS.items():
        if table not in tables:
            continue
        missing = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        grouped = tables[table].groupBy(*keys).agg(F.count("*").alias("_n"))
        surplus = F.when(missing, F.col("_n")).otherwise(F.col("_n") - 1)
        checks.append(_violations(grouped.agg(F.sum(surplus).alias("_v")), "primary_key", table, keys))
    for child, column, parent, key in FOREIGN_KEYS:
        if child not in tables or parent not in tables:
            continue
        values = tables[child].where(F.col(column).isNotNull()).groupBy(F.col(column).alias(key)).agg(
            F.count("*").alias("_n")
        )
        orphans = values.join(tables[parent].select(key), key, "left_anti")
        checks.append(_violations(orphans.agg(F.sum("_n").alias("_v")), "foreign_key", child, [column]))
    return reduce(DataFrame.unionByName, checks)


def _violations(total: DataFrame, kind: str, table: str, columns: list[str]) -> DataFrame:
    return total.select(
        F.lit(kind).alias("constraint"),
        F.lit(table).alias("table"),
        F.lit(",".join(columns)).alias("columns"),
        F.coalesce("_v", F.lit(0)).cast("bigint").alias("violations"),
    )
