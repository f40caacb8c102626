"""Claims-shaped views over the test tables (the test tables hold no claims)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


START, END = "2000-01-01", "2000-12-31"
VISIT_CODES = ("ECONOMY", "MEDIUM", "STANDARD")
PROCEDURE_MAP = [("PROMO", "S0"), ("PROMO", "S1"), ("LARGE", "S2"), ("SMALL", "S0")]

# Schemas already read from a file, so that later scans need not open its footer.
_SEEN: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SEEN:
        _SEEN[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SEEN[path]).parquet(path)


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))


def providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier")
    return supplier.join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("npi"),
        F.concat(F.lit("S"), F.col("s_suppkey") % 3).alias("specialty"),
        F.col("r_name").alias("practice_state"),
        F.col("n_name").alias("practice_city"),
        F.col("s_nationkey").cast("string").alias("practice_zip"),
        F.col("s_nationkey").cast("string").alias("tax_id"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("member_id"),
        F.col("c_mktsegment").alias("employer_group"),
    )


def _mistyped(spark: SparkSession, sf_dir: str, **suffixes: str) -> DataFrame:
    """Customers with the member id that a table has for them: some got a suffix when it was typed in."""
    name = F.col("c_custkey").cast("string")
    typed = name
    for suffix, condition in suffixes.items():
        typed = F.when(F.expr(condition), F.concat(name, F.lit(f"-{suffix}"))).otherwise(typed)
    return table(spark, sf_dir, "customer").select("c_custkey", typed.alias("member_id"))


def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    typed = _mistyped(spark, sf_dir, X="c_acctbal < -500", Y="c_acctbal > 9500")
    return table(spark, sf_dir, "orders").join(typed, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("eligibility_id"),
        "member_id",
        day.alias("coverage_start"),
        F.date_add(day, 180).alias("coverage_end"),
        F.date_add(day, (F.col("o_orderkey") % 91).cast("int")).alias("created_date"),
    )


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    key = lambda c: F.col(c).cast("string")
    typed = _mistyped(spark, sf_dir, X="c_acctbal <= 0")
    return (
        # orders meet customers first: of the wide rows there are as many as line items
        lineitem.join(orders.join(typed, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.concat_ws(
                "-", key("l_orderkey"), key("l_linenumber"), key("l_partkey"), key("l_suppkey")
            ).alias("claim_id"),
            "member_id",
            key("l_suppkey").alias("provider_npi"),
            F.when(F.col("l_linenumber") <= 2, (F.col("l_partkey") % 10).cast("string")).alias("referring_npi"),
            F.col("l_shipdate").cast("date").alias("service_date"),
            F.col("p_type").alias("procedure_code"),
            F.col("o_orderpriority").alias("diagnosis_code"),
            F.col("r_name").alias("service_state"),
            F.col("l_extendedprice").cast("decimal(12,2)").alias("allowed_amount"),
        )
    )


def procedure_map(spark: SparkSession) -> DataFrame:
    # VALUES is a relation of known size, so its joins need no shuffle.
    rows = ", ".join(f"('{code}', '{specialty}')" for code, specialty in PROCEDURE_MAP)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS m(procedure_code, expected_specialty)")


class ClaimsTables(Mapping):
    """The five tables by name; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        builders = (providers, members, eligibility, claims)
        self._builders = {b.__name__: partial(b, spark, sf_dir) for b in builders}
        self._builders["specialty_procedure_map"] = partial(procedure_map, spark)
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self):
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


claims_tables = ClaimsTables
