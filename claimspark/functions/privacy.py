"""Masking of personal data: whole columns by name, patterns in free text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The column names treated as personal data, compared in lower case.
PII_COLUMNS = frozenset(
    {
        "ssn", "social_security", "member_ssn",
        "date_of_birth", "dob", "birth_date",
        "street_address", "address_line_1", "address_line_2",
        "phone_number", "phone", "email", "email_address",
        "first_name", "last_name", "full_name", "member_name",
        "bank_account", "credit_card",
    }
)

# The placeholders that stand for removed data.
REDACTED = "***REDACTED***"
SSN_MASK = "***-**-****"
PHONE_MASK = "***-***-****"

# Word edges, digits and spaces count as in Unicode text, so a number glued to an
# accented letter is not one, and digits of other scripts are.
_EDGE_BEFORE = r"(?<![\p{L}\p{N}_])"
_EDGE_AFTER = r"(?![\p{L}\p{N}_])"
_SPACE = r"[\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
SSN_PATTERN = _EDGE_BEFORE + r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}" + _EDGE_AFTER
PHONE_PATTERN = (
    _EDGE_BEFORE + r"\p{Nd}{3}[-.)]" + _SPACE + r"*\p{Nd}{3}[-.)]" + _SPACE + r"*\p{Nd}{4}" + _EDGE_AFTER
)


def is_pii(column: str) -> bool:
    return column.lower() in PII_COLUMNS


def mask_pii(df: DataFrame) -> DataFrame:
    """Replace every value, NULLs included, of the personal-data columns.

    The columns become literals, so column pruning keeps the real values out of
    the scan.
    """
    return df.select(
        *[F.lit(REDACTED).alias(c) if is_pii(c) else F.col(f"`{c}`") for c in df.columns]
    )


def mask_record(record: Mapping[str, object]) -> dict[str, object]:
    """``mask_pii`` for one record on the driver, such as a row to be displayed."""
    return {name: REDACTED if is_pii(name) else value for name, value in record.items()}


def mask_text(text: Column) -> Column:
    """Mask social security numbers, then phone numbers, in a string column."""
    return F.regexp_replace(F.regexp_replace(text, SSN_PATTERN, SSN_MASK), PHONE_PATTERN, PHONE_MASK)
