"""Numeric clean-up expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def nan_to_null(c: Column) -> Column:
    return F.when(F.isnan(c), None).otherwise(c)


def finite(c: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def to_double(c: str | Column) -> Column:
    """Coerce to a finite double; anything else is NULL."""
    return finite((F.col(c) if isinstance(c, str) else c).try_cast("double"))


def half_even_int(c: str | Column) -> Column:
    """Round half to even into a nullable 32-bit integer."""
    return F.bround(to_double(c), 0).try_cast("int")
