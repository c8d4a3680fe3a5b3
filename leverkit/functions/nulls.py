"""NULL rules of the source analyses, spelled out as Column expressions.

The originals were written against R vectors, whose missing-value rules
differ from SQL's in a handful of places.  Each helper below names one rule
so call sites say which one they want.
"""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColOrName = Column | str


def col(c: ColOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(cond: Column) -> Column:
    """Three-valued boolean -> 1/0/NULL (``ifelse(cond, 1, 0)``: NA stays NA)."""
    return cond.cast("int")


def flag0(cond: Column) -> Column:
    """Boolean -> 1/0 with NULL counted as 0 (``sum(cond, na.rm=TRUE)`` terms)."""
    return F.when(cond, 1).otherwise(0)


def in_set(c: ColOrName, values: Iterable) -> Column:
    """Membership where a NULL value is simply not a member (never NULL)."""
    return F.coalesce(col(c).isin(list(values)), F.lit(False))


def zsum(c: ColOrName) -> Column:
    """Sum skipping NULLs; an all-NULL (or empty) group sums to 0."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def count_if(cond: Column) -> Column:
    """Number of rows where ``cond`` is true (NULL counts as false)."""
    return F.coalesce(F.sum(flag0(cond)), F.lit(0)).cast("long")


def strict_sum(c: ColOrName) -> Column:
    """Sum that is NULL as soon as one input is NULL (a sum without na.rm)."""
    x = col(c)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def safe_div(n: ColOrName, d: ColOrName) -> Column:
    """Division that yields NULL instead of an error / infinity at d = 0."""
    return F.try_divide(col(n).cast("double"), col(d).cast("double"))


def ratio_or_zero(n: ColOrName, d: ColOrName) -> Column:
    """``ifelse(d != 0, n / d, 0)``."""
    return F.when(col(d) != 0, col(n) / col(d)).when(col(d) == 0, F.lit(0.0))


def finite(c: ColOrName) -> Column:
    """True only for a real, finite number (drops NULL, NaN and +-inf)."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def nan_to_null(c: ColOrName) -> Column:
    x = col(c)
    return F.when(~F.isnan(x), x)
