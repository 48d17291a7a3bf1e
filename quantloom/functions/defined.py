"""Columns under one rule: NaN and infinities are undefined, and undefined is NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fin(x: Column | str) -> Column:
    """The value as a double, NULL where it is NaN or infinite."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def sdiv(a: Column, b: Column) -> Column:
    """a / b, NULL where that isn't finite."""
    return fin(F.try_divide(a, b))


def both(f, a: Column, b: Column) -> Column:
    """``f`` of two columns, NULL where one is (greatest and least skip NULLs)."""
    return F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def max2(a: Column, b: Column) -> Column:
    return both(F.greatest, a, b)


def min2(a: Column, b: Column) -> Column:
    return both(F.least, a, b)


def iff(condition: Column, then: Column, other: Column) -> Column:
    """``then`` or ``other``; NULL where the condition is undefined."""
    return F.when(condition.isNull(), None).when(condition, then).otherwise(other)


def less(a: Column, b: Column) -> Column:
    """1 where a < b, else 0; NULL where one is."""
    return iff(a < b, F.lit(1.0), F.lit(0.0))


def signed_power(x: Column, e: Column) -> Column:
    """sign(x) * abs(x)**e; a base of 1 or -1 stays itself whatever the exponent, even undefined."""
    return fin(F.when(F.abs(x) == 1.0, F.signum(x)).otherwise(F.signum(x) * F.pow(F.abs(x), e)))


SNAP_BITS, CORRELATION_BITS = 40, 24


def snap(x: Column, bits: int = SNAP_BITS) -> Column:
    """The value in steps of 2**-bits, beyond 1 in steps of 2**-bits of its leading power of two.

    Values that are equal but for rounding become equal, so what depends on their order alone (ranks, places of extremes) is the same
    whichever way sums were added up.  Correlations, which lose digits where values hardly vary, take CORRELATION_BITS.  The offset
    keeps halves away from a step's border.
    """
    size = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(0)))
    steps = float(1 << bits)
    return F.floor(x / size * steps + 0.3).cast("double") * size / steps
