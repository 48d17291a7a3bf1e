"""Cross-sectional operators: statistics within the rows of a date (or any group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import col, fin
from ..functions.names import fresh
from ..sources.scratch import Scratch
from .dealt import attach_rows
from .selection import select_ranks


def center_xsection(target_col: str, over_col: str, standardize: bool = False) -> Column:
    """Value less its group's mean; with ``standardize`` also by the group's sample deviation (NULL if that is 0 or undefined)."""
    over, x = W.partitionBy(over_col), fin(target_col)
    centred = x - F.avg(x).over(over)
    return fin(F.try_divide(centred, F.stddev_samp(x).over(over))) if standardize else centred


def norm_xsection(target_col: str, over_col: str, lower: float = 0.0, upper: float = 1.0) -> Column:
    """Min-max scaling of a group to [lower, upper]; ``lower`` where all its values are equal or none is defined, a NaN stays NULL."""
    over, raw = W.partitionBy(over_col), col(target_col).cast("double")
    x = fin(target_col)
    low, high = F.min(x).over(over), F.max(x).over(over)
    scaled = F.lit(float(lower)) + F.try_divide((x - low) * float(upper - lower), high - low)
    return F.when(F.isnan(raw) | (raw.isNotNull() & x.isNull()), None).when(low < high, scaled).otherwise(F.lit(float(lower)))


def _check_percentile(percentile: float) -> None:
    if isinstance(percentile, bool) or not isinstance(percentile, (int, float)):
        raise TypeError("percentile must be a number")
    if not 0 <= percentile <= 1:
        raise ValueError("percentile must lie in [0, 1]")


def _clip(x: Column, low: Column, high: Column) -> Column:
    """Into [low, high]; infinities too, NaN and NULL give NULL; where low > high the upper bound holds."""
    return F.when(x.isNull() | F.isnan(x), None).otherwise(F.least(F.greatest(x, low), high))


def winsorize(data_col: str, percentile: float = 0.05) -> Column:
    """The elements of an array column clipped to the array's own linear ``percentile`` and 1 - ``percentile`` quantiles."""
    _check_percentile(percentile)
    defined = F.array_sort(F.filter(F.col(data_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def quantile(z: Column, q: float) -> Column:
        n = F.size(z)
        at = (n - 1) * F.lit(float(q))
        k = F.floor(at).cast("int")
        a, b = F.get(z, k), F.get(z, F.least(k + 1, n - 1))
        return a + (b - a) * (at - k)

    # bound as variables of outer lambdas: sorted once and both bounds found once an array, not once an element
    bounds = F.transform(F.array(defined), lambda z: F.struct(quantile(z, percentile).alias("low"), quantile(z, 1 - percentile).alias("high")))
    return F.transform(bounds, lambda b: F.transform(F.col(data_col), lambda v: _clip(v.cast("double"), b.low, b.high)))[0]


def winsorize_xsection(df: DataFrame, data_cols: list[str] | tuple[str, ...], group_col: str, percentile: float = 0.05, scratch: Scratch | None = None) -> DataFrame:
    """Clip columns to their group's linear quantiles at ``percentile`` and 1 - ``percentile``.

    Bounds are one row per group, joined back.  Without ``scratch`` a group's different values go through one aggregate, which is
    right for dates of some thousand symbols; with it they are found by distributed selection, for groups of any size.
    """
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    _check_percentile(percentile)
    missing = [c for c in (*data_cols, group_col) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    own = {c: fresh(f"__q{k}", df.columns) for k, c in enumerate(data_cols)}
    shares = (float(percentile), float(1 - percentile))
    if scratch is None:
        bounds = {q: F.percentile(fin(c), F.array(*map(F.lit, shares))) for c, q in own.items()}
        joined = _join_groups(df, (group_col,), bounds)
    else:
        at = lambda q: lambda n: F.floor((n - 1) * F.lit(q))
        above = lambda q: lambda n: F.ceil((n - 1) * F.lit(q))
        found = select_ranks(df, (group_col,), {q: fin(c) for c, q in own.items()}, {f"{k}{side}": f(q) for k, q in enumerate(shares) for side, f in (("a", at), ("b", above))}, scratch)

        def between(name: str, k: int, q: float) -> Column:
            place = (F.col(f"{name}_n") - 1) * F.lit(q)
            a, b = F.col(f"{name}_{k}a")["value"], F.col(f"{name}_{k}b")["value"]
            return F.when(a == b, a).otherwise(a + (b - a) * (place - F.floor(place)))

        joined = attach_rows(df, found.select(group_col, *[F.array(*[between(q, k, s) for k, s in enumerate(shares)]).alias(q) for q in own.values()]), [group_col])
    clipped = {c: _clip(F.col(c).cast("double"), F.col(q)[0], F.col(q)[1]) for c, q in own.items()}
    return joined.select(*[clipped[c].alias(c) if c in clipped else F.col(c) for c in df.columns])


def _nearest(q: float):
    """The rank, from 0, next to the share ``q`` of n values; halves up."""
    return lambda n: F.floor(F.lit(float(q)) * (n - 1) + 0.5)


def percentiles_xsection(target_col: str, over_col: str, lower_pct: float, upper_pct: float, fill_val: float = 0.0) -> Column:
    """Values at or beyond their group's nearest-rank quantiles stay, others give ``fill_val``.

    The nearest rank of quantile q among n values is round(q * (n - 1)), halves up.  A NaN counts as
    the largest value, so it stays (as NULL); a NULL gives ``fill_val``.
    """
    over, raw = W.partitionBy(over_col), col(target_col).cast("double")
    low, high = _nearest(lower_pct), _nearest(upper_pct)
    # a group is sorted once: a value is at or below the one at a place if no more values than that are smaller
    ordered = over.orderBy(raw.asc_nulls_last())
    n = F.count(raw).over(over)
    keep = (F.rank().over(ordered) - 1 <= low(n)) | (F.count(raw).over(ordered) > high(n))
    return F.when(raw.isNull(), F.lit(float(fill_val))).when(keep, fin(raw)).otherwise(F.lit(float(fill_val)))


def rank(x: Column | str, over_col: str = "date") -> Column:
    """Average rank among a group's defined values by their number, in (0, 1]."""
    x = fin(x)
    ordered = W.partitionBy(over_col).orderBy(x.asc_nulls_last())
    peers = F.count(x).over(ordered.rangeBetween(W.currentRow, W.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(ordered) + (peers - 1) / 2.0) / F.count(x).over(W.partitionBy(over_col)))


def scale(x: Column | str, over_col: str = "date", k: float = 1.0) -> Column:
    """k times the value by the group's sum of absolute values; NULL where that is 0."""
    x = fin(x)
    return F.try_divide(F.lit(float(k)) * x, F.sum(F.abs(x)).over(W.partitionBy(over_col)))


def neutralize(x: Column | str, group: Column | str, over_col: str = "date") -> Column:
    """Value less the mean of its class on its date; NULL without a class."""
    x, group = fin(x), col(group)
    return F.when(group.isNotNull(), x - F.avg(x).over(W.partitionBy(over_col, group)))


def _join_groups(df: DataFrame, over: tuple[str, ...], aggregates: dict[str, Column]) -> DataFrame:
    """One row of aggregates per group, joined back to the group's rows (equal keys, NULL too)."""
    names = [fresh(f"__k{i}", [*df.columns, *aggregates]) for i in range(len(over))]
    found = df.groupBy(*[F.col(c).alias(n) for c, n in zip(over, names)]).agg(*[v.alias(k) for k, v in aggregates.items()])
    on = F.lit(True)
    for c, n in zip(over, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return df.join(found, on, "left").drop(*names)


def mask_middle(df: DataFrame, target_col: str, over_col: str, lower_pct: float, upper_pct: float, fill_val: float = 0.0, scratch: Scratch | None = None) -> DataFrame:
    """percentiles_xsection() in place, its quantiles found once a group.

    Without ``scratch`` a group is sorted in one window.  Bounds that were computed apart and joined could miss their own row by a
    rounding.  With ``scratch``, distributed selection finds them in groups of any size; then ``target_col`` has to come out the same
    each time that it is computed.
    """
    if scratch is None:
        return df.withColumn(target_col, percentiles_xsection(target_col, over_col, lower_pct, upper_pct, fill_val)).select(*df.columns)
    raw = F.col(target_col).cast("double")
    lo, hi = fresh("__lo", df.columns), fresh("__hi", df.columns)
    found = select_ranks(df, (over_col,), {lo: raw}, {"lo": _nearest(lower_pct), "hi": _nearest(upper_pct)}, scratch)
    joined = attach_rows(df, found.select(over_col, F.col(f"{lo}_lo")["value"].alias(lo), F.col(f"{lo}_hi")["value"].alias(hi)), [over_col])
    keep = (raw <= F.col(lo)) | (raw >= F.col(hi))
    masked = F.when(raw.isNull(), F.lit(float(fill_val))).when(keep, fin(raw)).otherwise(F.lit(float(fill_val)))
    return joined.withColumn(target_col, masked).select(*df.columns)


def quantile_weights(df: DataFrame, target_col: str, over: tuple[str, ...], quantile: float = 0.2, name: str = "weight", scratch: Scratch | None = None) -> DataFrame:
    """Add long-short weights: +0.5 shared among the top ``quantile`` of defined values, -0.5 among the bottom.

    A tail takes in all ties of its boundary value.  Where both boundaries meet, the extremes are the
    boundaries; a constant cross-section has no position.  An undefined value has weight 0.  Without ``scratch`` a group is
    sorted in one window, which tells each value's place; with it boundaries and tail sizes are found by distributed selection, for
    groups of any size, and joined back.
    """
    x, b_name = fin(target_col), fresh("__b", [*df.columns, name])
    tail = lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(float(quantile))))
    if scratch is None:
        group = W.partitionBy(*over) if over else W.partitionBy(F.lit(0))
        ordered = group.orderBy(x.asc_nulls_last())
        at = fresh("__at", [*df.columns, name, b_name])
        placed = df.withColumn(at, F.when(x.isNotNull(), F.struct(x.alias("x"), (F.rank().over(ordered) - 1).alias("below"), F.count(x).over(ordered).alias("upto"), F.count(x).over(group).alias("n"))))
        p = lambda f: F.col(at).getField(f)
        low, high = p("below") <= tail(p("n")) - 1, p("upto") > p("n") - tail(p("n"))
        lo, hi = F.max(F.when(low, p("x"))).over(group), F.min(F.when(high, p("x"))).over(group)
        count = lambda c: F.count(F.when(c, 1)).over(group)
        ends = F.struct(F.min(p("x")).over(group).alias("lo"), F.max(p("x")).over(group).alias("hi"), count(p("below") == 0).alias("below"), count(p("upto") == p("n")).alias("above"))
        bounds = F.when(lo >= hi, ends).otherwise(F.struct(lo.alias("lo"), hi.alias("hi"), count(low).alias("below"), count(high).alias("above")))
        joined = placed.withColumn(b_name, bounds).drop(at)
    else:
        found = select_ranks(df, over, {b_name: x}, {"low": lambda n: tail(n) - 1, "high": lambda n: n - tail(n), "least": lambda n: n * 0, "most": lambda n: n - 1}, scratch)
        p = lambda place, f: F.col(f"{b_name}_{place}")[f]
        meet = p("low", "value") >= p("high", "value")
        short, long = F.when(meet, F.col(f"{b_name}_least")).otherwise(F.col(f"{b_name}_low")), F.when(meet, F.col(f"{b_name}_most")).otherwise(F.col(f"{b_name}_high"))
        bounds = F.struct(short["value"].alias("lo"), long["value"].alias("hi"), (short["below"] + short["equal"]).alias("below"), (F.col(f"{b_name}_n") - long["below"]).alias("above"))
        joined = attach_rows(df, found.select(*over, bounds.alias(b_name)), list(over))
    b = lambda f: F.col(b_name).getField(f)
    weight = F.when(x.isNull() | b("lo").isNull() | (b("lo") >= b("hi")), 0.0).when(x <= b("lo"), F.lit(-0.5) / b("below")).when(x >= b("hi"), F.lit(0.5) / b("above")).otherwise(0.0)
    return joined.withColumn(name, weight).drop(b_name)


def top_n_by_group(df: DataFrame, n: int, rank_var: str, group_var: tuple[str, ...], filter: bool = True) -> DataFrame:  # noqa: A002
    """The ``n`` rows of each group with the largest ``rank_var`` (exactly n; ties by the other columns), or all rows
    with a 0/1 ``rank_mask``.  An undefined ``rank_var`` never ranks."""
    missing = [c for c in (rank_var, *group_var) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rest = [F.col(c) for c in df.columns if c != rank_var and c not in group_var]
    place = F.row_number().over(W.partitionBy(*group_var).orderBy(F.col(rank_var).desc_nulls_last(), *rest))
    own = fresh("__place", df.columns)
    chosen = F.col(rank_var).isNotNull() & (F.col(own) <= n)
    placed = df.withColumn(own, place)
    if filter:
        return placed.where(chosen).drop(own).orderBy(*group_var, rank_var)
    return placed.withColumn("rank_mask", F.when(chosen, 1).otherwise(0)).drop(own).orderBy(*group_var, rank_var)
