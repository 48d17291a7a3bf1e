"""Joins that a panel needs: as-of, dense grid, classifications."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fresh
from ..sources.scratch import Scratch
from .histories import running


def asof_backward(left: DataFrame, right: DataFrame, by: str, on: str, value: str, arrival: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``left`` with the ``right`` value at the same or the latest earlier ``on`` of the same ``by``.

    Both sides are put in one table and the last value is carried forward: one shuffle, no range join.
    NULL values of ``right`` are passed over; of equal keys the one with the largest ``arrival`` counts, without such a column
    the largest value.  With ``scratch`` a history may be longer than a task: slices of it hand on their last value.
    """
    columns = left.columns
    found, side, carried = (fresh(c, columns) for c in ("__value", "__side", "__carried"))
    best = F.max(value) if arrival is None else F.max_by(value, arrival)
    marks = right.where(F.col(value).isNotNull()).groupBy(by, on).agg(best.alias(found))
    both = left.withColumn(side, F.lit(1)).unionByName(marks.withColumn(side, F.lit(0)), allowMissingColumns=True)
    if scratch is None:
        order = W.partitionBy(by).orderBy(on, side).rowsBetween(W.unboundedPreceding, 0)
        joined = both.withColumn(carried, F.last(found, ignorenulls=True).over(order))
    else:
        joined = running(both, {carried: ("last", found)}, by, (on, side), scratch)
    return joined.where(F.col(side) == 1).select(*[c for c in columns if c != value], F.col(carried).alias(value))


def keep_last(df: DataFrame, keys: tuple[str, ...], arrival: str) -> DataFrame:
    """One row for each of ``keys`` (NULLs are keys), the one with the largest ``arrival``; of equal ones the largest row."""
    rest = [c for c in df.columns if c not in keys]
    own = fresh("__row", df.columns)
    picked = df.groupBy(*keys).agg(F.max(F.struct(F.col(arrival).alias("first"), F.struct(*rest).alias("row"))).alias(own))
    return picked.select(*[F.col(c) if c in keys else F.col(own)["row"][c].alias(c) for c in df.columns])


def dense_grid(df: DataFrame, symbol: str = "symbol", date: str = "date") -> DataFrame:
    """Every symbol on every date, with ``date_idx`` (0 for the first date) and ``present``; absent measures are NULL.

    Dates are numbered once and each symbol is exploded over the numbers, so there is no cross join.
    """
    dates = df.select(date).distinct().withColumn("date_idx", F.row_number().over(W.orderBy(date)) - 1)
    last = dates.agg(F.max("date_idx")).first()[0]
    if last is None:
        return df.withColumns({"date_idx": F.lit(0), "present": F.lit(True)})
    grid = df.select(symbol).distinct().withColumn("date_idx", F.explode(F.sequence(F.lit(0), F.lit(last))))
    measures = [c for c in df.columns if c not in (symbol, date)]
    joined = grid.join(dates, "date_idx").join(df.withColumn("present", F.lit(True)), [symbol, date], "left")
    return joined.select(symbol, date, "date_idx", *measures, F.coalesce("present", F.lit(False)).alias("present"))


def attach_classes(panel: DataFrame, classes: DataFrame, levels: list[str]) -> DataFrame:
    """Class columns joined on symbol, or on (date, symbol) where ``classes`` has dates; of duplicates the largest."""
    keys = ["date", "symbol"] if "date" in classes.columns else ["symbol"]
    unique = classes.groupBy(*keys).agg(F.max(F.struct(*levels)).alias("__c")).select(*keys, *[F.col("__c").getField(c).alias(c) for c in levels])
    return panel.join(unique, keys, "left")
