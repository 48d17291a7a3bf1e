"""Time-series operators: trailing windows of rows within a symbol, ordered by date.

A window is defined only where all its values are; lookbacks are rounded down to at least one row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import col, fin


def lookback(w: float) -> int:
    return max(1, math.floor(w))


class Rolling:
    """Operators over rows partitioned by ``by`` and ordered by ``order``."""

    def __init__(self, by: str = "symbol", order: str = "date"):
        self.by, self.order = by, order

    @property
    def whole(self):
        return W.partitionBy(self.by).orderBy(self.order)

    def frame(self, w: float):
        return self.whole.rowsBetween(1 - lookback(w), 0)

    def full(self, x: Column, w: float, value: Column) -> Column:
        return F.when(F.count(x).over(self.frame(w)) == lookback(w), value)

    def _agg(self, x, w: float, f) -> Column:
        x = fin(x)
        return self.full(x, w, f(x).over(self.frame(w)))

    def delay(self, x, d: float) -> Column:
        return F.lag(col(x), lookback(d)).over(self.whole)

    def delta(self, x, d: float) -> Column:
        return col(x) - self.delay(x, d)

    def sum(self, x, w: float) -> Column:
        return self._agg(x, w, F.sum)

    def mean(self, x, w: float) -> Column:
        return self._agg(x, w, F.avg)

    def std(self, x, w: float) -> Column:
        return self._agg(x, w, F.stddev_samp)

    def min(self, x, w: float) -> Column:
        return self._agg(x, w, F.min)

    def max(self, x, w: float) -> Column:
        return self._agg(x, w, F.max)

    def product(self, x, w: float) -> Column:
        return self._agg(x, w, F.product)

    def correlation(self, x, y, w: float) -> Column:
        """Pearson correlation; 0 where a side doesn't vary."""
        x, y, over = fin(x), fin(y), self.frame(w)
        spread = F.stddev_pop(x).over(over) * F.stddev_pop(y).over(over)
        flat = (F.min(x).over(over) == F.max(x).over(over)) | (F.min(y).over(over) == F.max(y).over(over))
        value = F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(F.covar_pop(x, y).over(over), spread), F.lit(0.0)))
        return self.full(x + y, w, value)

    def covariance(self, x, y, w: float) -> Column:
        x, y = fin(x), fin(y)
        return self.full(x + y, w, F.covar_samp(x, y).over(self.frame(w)))

    def _values(self, x, w: float, f) -> Column:
        x = fin(x)
        values = F.collect_list(x).over(self.frame(w))
        return F.when(F.size(values) == lookback(w), f(values))

    def rank(self, x, w: float) -> Column:
        """Average rank of the newest value within its window by the window's length."""

        def place(z: Column) -> Column:
            last = F.element_at(z, -1)
            count = lambda f: F.size(F.filter(z, f))
            return (count(lambda v: v < last) + (count(lambda v: v == last) + 1) / 2.0) / float(lookback(w))

        return self._values(x, w, place)

    def argmax(self, x, w: float) -> Column:
        """Position of the largest value, 1 for the oldest; the first of equals."""
        return self._values(x, w, lambda z: F.array_position(z, F.array_max(z)).cast("double"))

    def argmin(self, x, w: float) -> Column:
        return self._values(x, w, lambda z: F.array_position(z, F.array_min(z)).cast("double"))

    def decay_linear(self, x, w: float) -> Column:
        """Mean with weights 1 to w, the newest heaviest."""
        n = lookback(w)
        weights = F.array(*[F.lit(2.0 * k / (n * (n + 1))) for k in range(1, n + 1)])
        return self._values(x, w, lambda z: F.aggregate(F.zip_with(z, weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))

    def weighted_product(self, x, weights: list[float]) -> Column:
        """Product of 1 + value * weight over the window, less 1; the last weight is the newest row's."""
        array = F.array(*map(F.lit, weights))
        return self._values(x, len(weights), lambda z: F.aggregate(F.zip_with(z, array, lambda a, b: 1.0 + a * b), F.lit(1.0), lambda a, b: a * b) - 1.0)

    def forward_fill(self, x) -> Column:
        return F.last(fin(x), ignorenulls=True).over(self.whole.rowsBetween(W.unboundedPreceding, 0))

    def change(self, x) -> Column:
        """Relative change from the row before; nothing is filled."""
        return fin(F.try_divide(fin(x), F.lag(fin(x)).over(self.whole))) - 1.0

    def lead(self, x, d: int = 1) -> Column:
        return F.lead(col(x), d).over(self.whole)

    def wealth(self, returns) -> Column:
        """Running product of 1 + return."""
        return F.product(1.0 + col(returns)).over(self.whole.rowsBetween(W.unboundedPreceding, 0))
