"""Column helpers that fix types and NULL behaviour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: Column | str) -> Column:
    """Exact two-digit decimal: sums don't depend on the order of the rows, and -0.0 becomes 0."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(15,2)")


def day(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("date")


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and NULL where b is 0 or an input is NULL."""
    return F.try_divide(a, b)


def exact_avg(c: Column) -> Column:
    """Average of an exact numeric, as one division of two exact totals."""
    return F.sum(c).cast("double") / F.count(c)


def prefix(c: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(c, 1, n)


__all__ = ["day", "exact_avg", "money", "prefix", "safe_divide"]
