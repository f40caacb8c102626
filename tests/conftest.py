from __future__ import annotations

import os
import sys
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimspark.sources.schemas import SCHEMAS  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("claimspark-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def build(spark):
    """build(claims=[...], providers=[...]) -> tables; rows give only what matters."""

    def frame(table, rows):
        fields = SCHEMAS[table].fields
        values = []
        for number, row in enumerate(rows):
            full = {f.name: None for f in fields}
            if table == "claims":
                full |= {"claim_id": f"C{number}", "member_id": "M1", "provider_npi": "A",
                         "allowed_amount": 100, "service_date": "2025-06-02"}
            full |= row
            values.append(tuple(_typed(f.dataType.simpleString(), full[f.name]) for f in fields))
        return spark.createDataFrame(values, SCHEMAS[table])

    def tables(**rows):
        return {name: frame(name, rows.get(name, [])) for name in SCHEMAS}

    return tables


def _typed(kind, value):
    if value is None:
        return None
    if kind == "date" and isinstance(value, str):
        return date.fromisoformat(value)
    if kind.startswith("decimal"):
        return Decimal(str(value)).quantize(Decimal("0.01"))
    return value


@pytest.fixture
def rows():
    """rows(df, 'a', 'b') -> sorted list of tuples."""

    def collect(df, *columns):
        return sorted(
            (tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=lambda t: tuple(str(v) for v in t)
        )

    return collect
