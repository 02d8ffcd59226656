"""Small numeric rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, on_zero: float | None = None) -> Column:
    """a / b; on_zero (null by default) where b is zero. A null operand gives null."""
    out = F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))
    return out if on_zero is None else F.when(b == 0, F.lit(on_zero)).otherwise(out)


def zero_ratio(a: Column, b: Column) -> Column:
    """a / b with missing operands as zero and 0.0 for a zero denominator."""
    x, y = F.coalesce(a.cast("double"), F.lit(0.0)), F.coalesce(b.cast("double"), F.lit(0.0))
    return F.when(y == 0, F.lit(0.0)).otherwise(F.try_divide(x, y))


def growth(now: Column, then: Column) -> Column:
    """Percent change from then to now, null if then is zero or either is null; then counts by its absolute value."""
    return ratio(now - then, F.abs(then)) * 100


def cagr(first: Column, last: Column, years: Column) -> Column:
    """Compound growth a year in percent; null unless both ends and the years are positive."""
    return F.when((first > 0) & (last > 0) & (years > 0), (F.pow(last / first, F.lit(1.0) / years) - 1) * 100)


def scale_of(largest: Column) -> Column:
    """The divisor that brings the largest absolute value of a group below 1,000: 10**12, 10**9, 10**6, 10**3 or 1."""
    x = F.abs(largest)
    return F.when(x >= 1e12, 1e12).when(x >= 1e9, 1e9).when(x >= 1e6, 1e6).when(x >= 1e3, 1e3).otherwise(1.0)


def micro(c: Column) -> Column:
    """c in whole millionths: comparisons between engines don't hang on the order of additions."""
    return F.round(c * 1e6).cast("bigint")


def flow_cagr(series: Column) -> Column:
    """Compound growth a step of an array, as a fraction; 0 for fewer than two values or where an end isn't positive."""
    a, z, n = F.get(series, F.lit(0)), F.element_at(series, -1), F.size(series) - 1
    return F.when((n >= 1) & (a > 0) & (z > 0), F.pow(z / a, F.lit(1.0) / n) - 1).otherwise(F.lit(0.0))
