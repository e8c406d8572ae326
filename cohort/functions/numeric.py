"""Numeric column expressions (X1-X6, N9). ANSI mode is on in Spark 4, so
every division and cast here is the non-raising ``try_`` form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def coerce_numeric(c: Column | str, default: float = 0.0) -> Column:
    """Lenient conversion; bad or missing -> ``default``."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(float(default)))


def family_size(sibsp: Column | str, parch: Column | str) -> Column:
    """siblings/spouses + parents/children + 1."""
    return _c(sibsp) + _c(parch) + F.lit(1)


def is_alone(size: Column | str) -> Column:
    """1 unless the family size is above 1 (null size -> 1)."""
    return F.when(_c(size) > 1, F.lit(0)).otherwise(F.lit(1))


def product(a: Column | str | None, b: Column | str | None) -> Column:
    """Null-safe product; an absent operand (None) gives 0, a null or
    non-numeric value counts as 0."""
    if a is None or b is None:
        return F.lit(0.0)
    return coerce_numeric(a) * coerce_numeric(b)


def guarded_ratio(num: Column | str, den: Column | str) -> Column:
    """Num null -> 0 then 0 -> 1e-6; den null -> 1, 0 -> 1."""
    n = coerce_numeric(num)
    n = F.when(n == 0, F.lit(1e-6)).otherwise(n)
    d = coerce_numeric(den, 1.0)
    d = F.when(d == 0, F.lit(1.0)).otherwise(d)
    return n / d


def loneliness(alone: Column | str, age: Column | str, threshold: float = 30.0) -> Column:
    """Alone and age strictly above the threshold; null age counts 0."""
    return ((_c(alone) == 1) & (coerce_numeric(age) > threshold)).cast("int")
