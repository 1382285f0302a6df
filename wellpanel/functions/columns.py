"""Reusable column expressions; all of them stay inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wellpanel.schema import MEASURE, SPARK_TYPES

#: Fixed value: what stands in for NULL inside a hashed key.
NULL_KEY_TOKEN = "_dbt_utils_surrogate_key_null_"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: str | Column) -> Column:
    """Trimmed text, NULL when nothing is left."""
    return F.nullif(F.trim(_col(c)), F.lit(""))


def non_negative(c: str | Column) -> Column:
    """Decimal measure; blank and negative become NULL, zero stays."""
    amount = blank_to_null(c).cast(MEASURE)
    return F.when(amount >= 0, amount)


def month_from_parts(year: str | Column, month: str | Column) -> Column:
    """First day of the month; an impossible month raises under ANSI."""
    return F.make_date(_col(year).cast("int"), _col(month).cast("int"), F.lit(1))


def month_start(c: str | Column) -> Column:
    return F.trunc(_col(c), "MM")


def month_index(c: str | Column) -> Column:
    """Months since year 0 as an integer."""
    return F.year(_col(c)) * 12 + F.month(_col(c))


def months_between_int(later: str | Column, earlier: str | Column) -> Column:
    """Whole months between two first-of-month dates."""
    return (month_index(later) - month_index(earlier)).cast("int")


def shift_months(c: str | Column, k: int | Column) -> Column:
    """Month start ``k`` months after ``c``; the day of month is ignored."""
    return F.add_months(month_start(c), k)


def surrogate_key(*columns: str | Column) -> Column:
    """Deterministic hash of a business key, the same in facts and dimensions."""
    parts = [F.coalesce(_col(c).cast("string"), F.lit(NULL_KEY_TOKEN)) for c in columns]
    return F.md5(F.concat_ws("-", *parts))


def differs(a: Column, b: Column) -> Column:
    """NULL-safe inequality: never NULL itself."""
    return ~a.eqNullSafe(b)


def differs_beyond(a: Column, b: Column, tolerance: float = 1e-6) -> Column:
    """One side missing, or further apart than ``tolerance``."""
    return (a.isNull() != b.isNull()) | F.coalesce(F.abs(a - b) > tolerance, F.lit(False))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, conditions)


def contains_text(c: str | Column, needle: str) -> Column:
    """Case-insensitive containment; the needle is LIKE text, as in an ILIKE report filter."""
    return _col(c).ilike(f"%{needle}%")


def lenient(c: str | Column, kind: str) -> Column:
    """Coerce to a contract kind; what does not parse becomes NULL."""
    return _col(c).try_cast(SPARK_TYPES[kind])


def strict(c: str | Column, kind: str) -> Column:
    """Coerce to a contract kind; what does not parse raises (ANSI mode)."""
    return _col(c).cast(SPARK_TYPES[kind])
