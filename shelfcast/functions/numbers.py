"""Numeric column expressions with explicit undefined values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null when the whole is zero or null."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0.0))


def relative_reduction(base: Column, candidate: Column) -> Column:
    """Percentage by which ``candidate`` lies below a positive ``base``."""
    return F.when(base > 0, F.lit(100.0) * (base - candidate) / base)


def finite_or_fail(value: Column, message: str) -> Column:
    """The value itself; the job stops on null, NaN or an infinity."""
    usable = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(usable, value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def number_or_null(text: Column) -> Column:
    """Numeric text as double; malformed text and NaN become null."""
    parsed = text.try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def money(value: Column) -> Column:
    """Exact money, so that sums do not depend on the order of addition."""
    return value.cast("decimal(18,4)")


def count_true(flag: Column) -> Column:
    return F.count_if(flag).cast("long")
