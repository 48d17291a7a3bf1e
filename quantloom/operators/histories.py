"""Running values along histories that are longer than a task: each slice of time starts from what the slices before it hand on.

Rows are range-partitioned by time once and written with their slice.  A slice hands on one row a symbol (its last defined value,
product, largest, ...), added up before the shuffle; a scan over these few rows gives what each slice starts from; and a
second pass over (symbol, slice), which one symbol's history fills many of, puts both together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import col
from ..functions.names import fresh
from ..sources.scratch import Scratch
from .dealt import SENT, attach_rows

# kind: running aggregate, how a slice's is merged with what it starts from, what the start is where there is none
_RUNNING = {
    "last": (lambda x: F.last(x, ignorenulls=True), lambda own, before: F.coalesce(own, before)),
    "sum": (F.sum, lambda own, before: F.coalesce(own + before, own, before)),
    "product": (F.product, lambda own, before: F.coalesce(own * before, own, before)),
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "count": (F.count, lambda own, before: own + F.coalesce(before, F.lit(0))),
}


def running(df: DataFrame, wanted: dict[str, tuple[str, Column | str]], by: str, order: tuple[str, ...], scratch: Scratch, slices: int | None = None, sent: int = SENT) -> DataFrame:
    """Add values that run along each ``by`` (NULL is a symbol too) from its first row up to each row, in the order of ``order``.

    ``wanted`` names (kind, column); kinds are last (defined value), sum, product, max, min and count, and skip NULLs.  The first of
    ``order`` is time, by which slices are cut; all of ``order`` must tell a symbol's rows apart.
    """
    if bad := [k for k, _ in wanted.values() if k not in _RUNNING]:
        raise ValueError(f"unknown kinds {bad}")
    taken = [*df.columns, *wanted]
    xs = {n: fresh(f"__x{k}", taken) for k, n in enumerate(wanted)}
    starts = {n: fresh(f"__b{k}", taken) for k, n in enumerate(wanted)}
    part = fresh("__slice", taken)
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keep = [c for c in df.columns if c not in wanted]
    cut = df.select("*", *[col(c).alias(xs[n]) for n, (_, c) in wanted.items()]).repartitionByRange(slices, order[0]).withColumn(part, F.spark_partition_id())
    cut = scratch.write(cut, "history")

    def last(x: str) -> Column:
        return F.max_by(x, F.when(F.col(x).isNotNull(), F.struct(*order)))

    ends = cut.groupBy(by, part).agg(*[(last(xs[n]) if kind == "last" else _RUNNING[kind][0](F.col(xs[n]))).alias(starts[n]) for n, (kind, _) in wanted.items()])
    over = W.partitionBy(by).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    before = {starts[n]: (F.sum if kind == "count" else _RUNNING[kind][0])(F.col(starts[n])).over(over) for n, (kind, _) in wanted.items()}
    carried = scratch.write(ends.select(by, part, *[v.alias(b) for b, v in before.items()]), "carried")
    inside = W.partitionBy(by, part).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = cut.withColumns({xs[n]: _RUNNING[kind][0](F.col(xs[n])).over(inside) for n, (kind, _) in wanted.items()})
    met = attach_rows(own, carried, [by, part], sent=sent, frequent={})  # no symbol and slice is large
    return met.select(*keep, *[_RUNNING[kind][1](F.col(xs[n]), F.col(starts[n])).alias(n) for n, (kind, _) in wanted.items()])
