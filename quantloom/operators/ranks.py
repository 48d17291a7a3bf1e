"""Ranks within groups: of many columns at once, and of groups larger than a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import fin, snap
from ..functions.names import fresh
from ..sources.scratch import Scratch
from .dealt import SENT, attach_rows


def rank_columns(df: DataFrame, arguments: dict[str, Column], over: str, by: str, bits: dict[str, int] | None = None) -> DataFrame:
    """Add the average rank by count, in (0, 1], of many columns within each ``over``; (``over``, ``by``) tells rows apart.

    Long form: a row a column and defined value, shuffled once by (``over``, column), so a task sorts narrow rows and one date's
    columns are ranked by many tasks.  ``bits`` says of columns in which steps their values are ranked (see ``snap``); 0: as they are.
    """
    taken = [*df.columns, *arguments]
    xs, e, x, place, k_over, k_by = (fresh(n, taken) for n in ("__xs", "__e", "__x", "__r", "__over", "__by"))
    names = list(arguments)
    rows = df.select(F.col(over).alias(k_over), F.col(by).alias(k_by), F.posexplode(F.array(*[fin(arguments[n]) for n in names])).alias(e, x)).where(F.col(x).isNotNull())
    stepped = F.col(x)
    for b in sorted(set((bits or {}).values()) - {0}):
        stepped = F.when(F.col(e).isin([k for k, n in enumerate(names) if bits.get(n) == b]), snap(F.col(x), b)).otherwise(stepped)
    rows = rows.withColumn(x, stepped)
    ordered = W.partitionBy(k_over, e).orderBy(x)
    peers = F.count("*").over(ordered.rangeBetween(W.currentRow, W.currentRow))
    ranked = rows.select(k_over, k_by, e, ((F.rank().over(ordered) + (peers - 1) / 2.0) / F.count("*").over(W.partitionBy(k_over, e))).alias(place))
    wide = ranked.groupBy(k_by, k_over).agg(*[F.max(F.when(F.col(e) == k, F.col(place))).alias(n) for k, n in enumerate(names)])
    return df.join(wide, (F.col(by) == F.col(k_by)) & (F.col(over) == F.col(k_over)), "left").drop(k_by, k_over)


def _splits(counts: DataFrame, groups: list[str], cells: DataFrame, rows_a_task: int, most: int = 512) -> DataFrame:
    """Split values of groups with over ``rows_a_task`` different values: quantiles of a mergeable sketch.

    They only decide which task counts what, so they needn't be exact; a group is cut in at most ``most`` parts.
    """
    large = counts.where(F.col("cells") > rows_a_task).select(*groups, F.least(F.lit(most), F.ceil(F.col("cells") / F.lit(rows_a_task))).alias("parts"))
    inside = attach_rows(cells, large, groups).where("parts is not null")
    sketch = inside.groupBy(*groups, "parts").agg(F.percentile_approx("x", [k / most for k in range(1, most)], 4 * most).alias("s"))
    step = F.ceil(F.lit(most) / F.col("parts"))
    return sketch.select(*groups, F.array_distinct(F.filter("s", lambda v, i: (i + 1) % step == 0)).alias("splits"))


def rank_groups(df: DataFrame, target_col: str, over: tuple[str, ...], name: str, scratch: Scratch, share: bool = True, rows_a_task: int = 500_000, sent: int = SENT) -> DataFrame:
    """Add the average rank of ``target_col`` among the defined values of its group (``share``: by their number), for groups of any size.

    Equal values become one row with a count before anything is sorted, so ties are counted whole and lie in one part.  A
    large group is cut at quantiles; a part's running count plus what smaller parts hold gives each value's
    rank, which is joined back to the rows by value, frequent values dealt out on several tasks.  NULL groups are groups; an
    undefined value has no rank.
    """
    taken = [*df.columns, name]
    x = fresh("__x", taken)
    source = df.withColumn(x, fin(target_col) + 0.0)
    own_groups = [F.col(c) for c in over] or [F.lit(0)]  # no columns: one group
    groups = [f"g{k}" for k in range(len(own_groups))]
    cells = source.where(F.col(x).isNotNull()).groupBy(*[c.alias(g) for c, g in zip(own_groups, groups)], F.col(x).alias("x")).agg(F.count("*").alias("m"))
    cells = scratch.write(cells, "rank-cells")
    counts = scratch.write(cells.groupBy(*groups).agg(F.count("*").alias("cells"), F.sum("m").alias("n")), "rank-counts")
    many = counts.count()
    if counts.where(F.col("cells") > rows_a_task).limit(1).count():
        splits = scratch.write(_splits(counts, groups, cells, rows_a_task), "rank-splits")
        cells = attach_rows(cells, splits, groups, many, sent).withColumn("part", F.coalesce(F.size(F.filter("splits", lambda v: v < F.col("x"))), F.lit(0))).drop("splits")
        cells = scratch.write(cells, "rank-parts")
    else:
        cells = cells.withColumn("part", F.lit(0))
    held = cells.groupBy(*groups, "part").agg(F.sum("m").alias("held"))
    own = W.partitionBy(*groups)
    offsets = held.select(*groups, "part", F.coalesce(F.sum("held").over(own.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("held").over(own).alias("n"))
    running = F.sum("m").over(W.partitionBy(*groups, "part").orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = cells.withColumn("upto", running)
    same = F.col("part") == F.col("r_part")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"r_{g}"))
    placed = placed.join(offsets.select(*[F.col(c).alias(f"r_{c}") for c in (*groups, "part")], "offset", "n"), same)
    average = F.col("offset") + F.col("upto") - (F.col("m") - 1) / 2.0
    value = average / F.col("n") if share else average
    found = scratch.write(placed.select(*[F.col(g).alias(c) for g, c in zip(groups, over)], F.col("x").alias(x), value.alias(name)), "rank-found")
    return attach_rows(source.drop(name) if name in df.columns else source, found, [*over, x], sent=sent).drop(x)
