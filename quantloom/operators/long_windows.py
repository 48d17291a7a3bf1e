"""Trailing windows of many rows, at a cost that doesn't grow with the window's length.

A sliding frame adds up all its rows again for every row.  Here a symbol's rows are cut into blocks as long as the window: a window
then is the end of one block and the start of the next.  Both are running aggregates, one upwards and one downwards, and
are merged: sums are added, moments merged from counts, means and centred sums, extremes compared.  No sum of a longer
history is subtracted from another, so no error builds up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import col, fin
from ..functions.names import fresh
from .rolling import lookback

KINDS = ("sum", "mean", "std", "min", "max", "product", "covariance", "correlation", "argmax", "argmin", "decay")


@dataclass(frozen=True)
class Long:
    """A window of ``w`` rows over ``x`` (and ``y`` for covariance and correlation), defined as Rolling's method of the same name."""

    kind: str
    x: Column | str
    w: float
    y: Column | str | None = None

    def __post_init__(self):
        if self.kind not in KINDS or (self.y is None) == (self.kind in ("covariance", "correlation")):
            raise ValueError(f"no window of kind {self.kind!r} with these columns")


def _parts(kind: str, x: str, y: str, place: str) -> dict[str, Column]:
    """The aggregates that a window of ``kind`` is merged from; ``place`` is the row's number, in its block for decay."""
    both = F.col(x) if kind not in ("covariance", "correlation") else F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), F.col(x))
    other = F.when(both.isNotNull(), F.col(y)) if kind in ("covariance", "correlation") else None
    found = {"n": F.count(both)}
    if kind in ("sum", "mean"):
        found["s"] = F.sum(both)
    elif kind in ("min", "max"):
        found["s"] = F.min(both) if kind == "min" else F.max(both)
    elif kind == "product":
        found["s"] = F.product(both)
    elif kind == "argmax":  # the largest, and of equals the first
        found["s"] = F.max(F.when(both.isNotNull(), F.struct(both.alias("v"), (-F.col(place)).alias("p"))))
    elif kind == "argmin":
        found["s"] = F.min(F.when(both.isNotNull(), F.struct(both.alias("v"), F.col(place).alias("p"))))
    elif kind == "decay":
        found |= {"s": F.sum(both), "t": F.sum(both * F.col(place))}
    elif kind == "std":
        found |= {"mx": F.avg(both), "xx": F.var_pop(both)}
    else:
        found |= {"mx": F.avg(both), "my": F.avg(other), "xy": F.covar_pop(both, other)}
        if kind == "correlation":
            found |= {"xx": F.var_pop(both), "yy": F.var_pop(other), "lx": F.min(both), "hx": F.max(both), "ly": F.min(other), "hy": F.max(other)}
    return found


def _merge(spec: Long, n: int, p, q, whole: Column, place: Column) -> Column:
    """The window's value from the part ``p`` in the row's own block and ``q`` in the block before (absent where ``whole``).

    ``place`` is the row's number, in its block for decay.
    """
    count = lambda side: F.coalesce(side("n"), F.lit(0))
    two = lambda f, name: F.when(whole | (count(q) == 0), p(name)).when(count(p) == 0, q(name)).otherwise(f(p(name), q(name)))
    total = F.when(whole, count(p)).otherwise(count(p) + count(q))

    def centred(own: str, a: str, b: str) -> Column:
        """Sum of products of deviations."""
        apart = (p(a) - q(a)) * (p(b) - q(b)) * count(p) * count(q) / total
        return F.when(whole | (count(q) == 0), p(own) * count(p)).when(count(p) == 0, q(own) * count(q)).otherwise(p(own) * count(p) + q(own) * count(q) + apart)

    add = lambda a, b: a + b
    if spec.kind in ("sum", "mean"):
        value = two(add, "s") / n if spec.kind == "mean" else two(add, "s")
    elif spec.kind in ("min", "max"):
        value = two(F.least if spec.kind == "min" else F.greatest, "s")
    elif spec.kind == "product":
        value = two(lambda a, b: a * b, "s")
    elif spec.kind in ("argmax", "argmin"):
        best = two(F.greatest if spec.kind == "argmax" else F.least, "s")
        value = (F.abs(best["p"]) - place + n).cast("double")
    elif spec.kind == "decay":  # a row weighs its place less this row's, and n more in this block
        here, before = p("t") + (n - place) * p("s"), F.when(whole | (count(q) == 0), 0.0).otherwise(q("t") - place * q("s"))
        value = (here + before) * (2.0 / (n * (n + 1)))
    elif spec.kind == "std":
        value = F.sqrt(centred("xx", "mx", "mx") / (n - 1)) if n > 1 else F.lit(None).cast("double")
    elif spec.kind == "covariance":
        value = centred("xy", "mx", "my") / (n - 1) if n > 1 else F.lit(None).cast("double")
    else:
        flat = (two(F.least, "lx") == two(F.greatest, "hx")) | (two(F.least, "ly") == two(F.greatest, "hy"))
        spread = F.sqrt(centred("xx", "mx", "mx")) * F.sqrt(centred("yy", "my", "my"))
        value = F.when(flat, 0.0).otherwise(F.coalesce(F.try_divide(centred("xy", "mx", "my"), spread), F.lit(0.0)))
    return F.when(total == n, value)


def long_windows(df: DataFrame, wanted: dict[str, Long], by: str = "symbol", order: str = "date") -> DataFrame:
    """Add the ``wanted`` windows over rows of ``by`` in the order of ``order``, which tells a symbol's rows apart.

    A window is defined where all its rows are there and defined.  One shuffle by ``by`` serves all; each length costs two sorts.
    """
    taken = [*df.columns, *wanted]
    place, block, own = (fresh(c, taken) for c in ("__place", "__block", "__own"))
    out = df.withColumn(place, F.row_number().over(W.partitionBy(by).orderBy(order)))
    keep = [c for c in df.columns if c not in wanted]
    wanted_names, results = list(wanted), {}
    lengths: dict[int, list[int]] = {}
    for k, name in enumerate(wanted_names):
        lengths.setdefault(lookback(wanted[name].w), []).append(k)
    for n, members in lengths.items():
        here, before = F.floor((F.col(place) - 1) / n), F.col(place) - 1
        values, up, down, made = {block: here, own: F.pmod(before, F.lit(n)) + 1}, {}, {}, {}
        inside, history = W.partitionBy(by, block), W.partitionBy(by).orderBy(order)
        forward = inside.orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
        backward = inside.orderBy(F.col(order).desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
        for k in members:
            spec = wanted[wanted_names[k]]
            x, y = (fresh(f"__{c}{k}", taken) for c in "xy")
            values |= {x: fin(spec.x)} | ({y: fin(spec.y)} if spec.y is not None else {})
            at = own if spec.kind == "decay" else place
            parts = _parts(spec.kind, x, y, at)
            label = {part: (fresh(f"__u{k}{part}", taken), fresh(f"__d{k}{part}", taken)) for part in parts}
            up |= {label[part][0]: f.over(forward) for part, f in parts.items()}
            down |= {label[part][1]: f.over(backward) for part, f in parts.items()}
            p, q = (lambda part, label=label, side=side: F.col(label[part][side]) for side in (0, 1))
            made[k] = F.when(F.col(place) >= n, _merge(spec, n, p, q, F.col(own) == n, F.col(at)))
        out = out.withColumns(values).withColumns(down).withColumns(up)
        # what the block before adds to a row's window begins n - 1 rows back
        out = out.withColumns({d: F.lag(d, n - 1).over(history) if n > 1 else F.col(d) for d in down})
        out = out.select(*df.columns, place, *results.values(), *[v.alias(fresh(f"__new{k}", taken)) for k, v in made.items()])
        results |= {wanted_names[k]: fresh(f"__new{k}", taken) for k in made}
    return out.select(*keep, *[F.col(results[name]).alias(name) for name in wanted])
