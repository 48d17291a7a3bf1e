"""Trailing windows that no running aggregate gives: places within the window, and weights that move with it.

Rows are shuffled once by symbol and sorted; a task goes over them in Arrow batches of many symbols and carries on only the rows that
windows of the next batch reach back to, which are fewer than the longest window and of one symbol.  Within a batch
all windows of a length are one strided view of the values, reduced in slices of bounded size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.defined import fin
from ..functions.names import fresh
from ..shipping import ship
from .rolling import lookback

SLICE = 1 << 21  # values of windows that are reduced at once


@dataclass(frozen=True)
class Carried:
    """A window of ``w`` rows over ``x`` that ends ``lag`` rows back; ``kind`` is rank, argmax, argmin, decay or weighted_product, as Rolling
    defines them.  ``weights`` (of a weighted_product) are as many as rows, the last for the newest."""

    kind: str
    x: Column | str
    w: float
    weights: Sequence[float] | None = None
    lag: int = 0

    def __post_init__(self):
        if self.kind not in _REDUCE or (self.weights is not None) != (self.kind == "weighted_product") or self.lag < 0:
            raise ValueError(f"no window of kind {self.kind!r} like this")
        if self.weights is not None and len(self.weights) != lookback(self.w):
            raise ValueError("a weight for each row of the window is needed")


def _rank(z: np.ndarray, _) -> np.ndarray:
    last = z[:, -1:]
    return ((z < last).sum(1) + ((z == last).sum(1) + 1) / 2.0) / z.shape[1]


_REDUCE = {
    "rank": _rank,
    "argmax": lambda z, _: z.argmax(1) + 1.0,
    "argmin": lambda z, _: z.argmin(1) + 1.0,
    "decay": lambda z, _: z @ (np.arange(1, z.shape[1] + 1) * (2.0 / (z.shape[1] * (z.shape[1] + 1)))),
    "weighted_product": lambda z, weights: np.prod(1.0 + z * weights, axis=1) - 1.0,
}


def _reduce(values: np.ndarray, ends: np.ndarray, w: int, kind: str, weights) -> np.ndarray:
    """The windows that end at ``ends``; NaN where a row is undefined."""
    out = np.full(len(ends), np.nan)
    step = max(1, SLICE // w)
    view = np.lib.stride_tricks.sliding_window_view(values, w) if len(values) >= w else None
    for a in range(0, len(ends), step):
        z = view[ends[a : a + step] - w + 1]
        whole = ~np.isnan(z).any(1)
        out[a : a + step][whole] = _REDUCE[kind](z[whole], weights)
    return out


def carried_windows(df: DataFrame, wanted: dict[str, Carried], by: str = "symbol", order: str = "date") -> DataFrame:
    """Add the ``wanted`` windows over rows of ``by`` (NULL is a symbol too) in the order of ``order``, which tells a symbol's rows apart.

    A window is defined where all its rows are there and defined.  A symbol's history goes through one task, in bounded memory.
    """
    spark = df.sparkSession
    ship(spark)
    taken = [*df.columns, *wanted]
    inputs = {name: fresh(f"__x{k}", taken) for k, name in enumerate(wanted)}
    keep = [c for c in df.columns if c not in wanted]
    made = {name: fresh(f"__new{k}", taken) for k, name in enumerate(wanted)}
    specs = [(inputs[n], made[n], s.kind, lookback(s.w), None if s.weights is None else np.array(s.weights, float), s.lag) for n, s in wanted.items()]
    reach = max(w + lag for *_, w, _, lag in specs) - 1
    rows = df.select("*", *[fin(s.x).alias(inputs[n]) for n, s in wanted.items()]).repartition(by).sortWithinPartitions(by, order)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        before, n_held = None, 0  # the symbol of the held rows
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            own = batch[by]
            codes = own.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            carried = n_held if n_held and own[0].as_py() == before else 0
            first = np.repeat(starts, np.diff(np.append(starts, n))) + carried  # where a row's symbol begins, among held rows and the batch
            first[first == carried] = 0
            at = np.arange(n) + carried
            columns, now = [], {}
            for x, _, kind, w, weights, lag in specs:
                values = batch[x].to_numpy(zero_copy_only=False).astype(float)
                values = now[x] = np.concatenate([held[x][-carried:], values]) if carried else values
                full = np.flatnonzero(at - lag - w + 1 >= first)
                found = np.full(n, np.nan)
                if len(full):
                    found[full] = _reduce(values, at[full] - lag, w, kind, weights)
                columns.append(pa.array(found, pa.float64(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *columns], [*keep, *made.values()])
            begin = max(int(first[-1]), carried + n - reach)
            held, before, n_held = {x: v[begin:] for x, v in now.items()}, own[n - 1].as_py(), carried + n - begin

    types = {f.name: f for f in df.schema.fields}
    schema = T.StructType([*[types[c] for c in keep], *[T.StructField(m, T.DoubleType()) for m in made.values()]])
    out = rows.mapInArrow(run, schema)
    return out.select(*keep, *[F.col(m).alias(n) for n, m in made.items()])
