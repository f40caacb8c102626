"""Fixed schemas of the five claims tables.

Codes and ids are strings: inference would turn them into numbers and lose
leading zeros.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns])


_TEXT, _DATE, _MONEY = T.StringType(), T.DateType(), T.DecimalType(12, 2)

SCHEMAS: dict[str, T.StructType] = {
    "providers": _schema(
        ("npi", _TEXT), ("first_name", _TEXT), ("last_name", _TEXT), ("specialty", _TEXT),
        ("practice_state", _TEXT), ("practice_city", _TEXT), ("practice_zip", _TEXT),
        ("tax_id", _TEXT), ("practice_type", _TEXT), ("enrollment_date", _DATE),
        ("is_active", T.BooleanType()),
    ),
    "members": _schema(
        ("member_id", _TEXT), ("date_of_birth", _DATE), ("gender", _TEXT), ("state", _TEXT),
        ("city", _TEXT), ("zip", _TEXT), ("plan_type", _TEXT), ("employer_group", _TEXT),
        ("risk_score", T.DecimalType(5, 2)),
    ),
    "eligibility": _schema(
        ("eligibility_id", _TEXT), ("member_id", _TEXT), ("coverage_start", _DATE),
        ("coverage_end", _DATE), ("plan_code", _TEXT), ("coverage_type", _TEXT),
        ("status", _TEXT), ("created_date", _DATE),
    ),
    "claims": _schema(
        ("claim_id", _TEXT), ("member_id", _TEXT), ("provider_npi", _TEXT),
        ("referring_npi", _TEXT), ("service_date", _DATE), ("paid_date", _DATE),
        ("procedure_code", _TEXT), ("diagnosis_code", _TEXT), ("diagnosis_desc", _TEXT),
        ("place_of_service", _TEXT), ("allowed_amount", _MONEY), ("paid_amount", _MONEY),
        ("member_liability", _MONEY), ("claim_type", _TEXT), ("service_state", _TEXT),
        ("modifier_1", _TEXT), ("modifier_2", _TEXT), ("units", T.IntegerType()),
        ("claim_status", _TEXT),
    ),
    "specialty_procedure_map": _schema(
        ("procedure_code", _TEXT), ("expected_specialty", _TEXT), ("category", _TEXT),
    ),
}

PRIMARY_KEYS: dict[str, list[str]] = {
    "providers": ["npi"],
    "members": ["member_id"],
    "eligibility": ["eligibility_id"],
    "claims": ["claim_id"],
    "specialty_procedure_map": ["procedure_code", "expected_specialty"],
}

# (child table, child column, parent table, parent column)
FOREIGN_KEYS: list[tuple[str, str, str, str]] = [
    ("claims", "member_id", "members", "member_id"),
    ("claims", "provider_npi", "providers", "npi"),
    ("eligibility", "member_id", "members", "member_id"),
]
