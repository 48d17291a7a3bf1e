"""Many expressions over a dense panel at once, in Arrow batches: windows over a symbol's rows, or ranks and classes within a date.

Spark shuffles and sorts the rows, by symbol for one kind and by date for the other; a task goes over them in batches and computes all
expressions of its stage column by column, so a nested window costs neither a plan of its own nor another pass over the rows.  Over symbols a task
carries on only the rows that the next batch's windows reach back to; within dates it holds one date's rows.  Undefined is
NaN here, and the functions are those of ``functions.defined``, ``Rolling`` and ``xsection`` of the same meaning.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..shipping import ship
from .rolling import lookback


PACK = "__pack"


@dataclass(frozen=True)
class Step:
    """``key`` is the function ``name`` of the columns or numbers ``args``; ``rest`` are its windows' lengths or steps."""

    key: str
    name: str
    args: tuple
    rest: tuple = ()


def fin(x):
    return np.where(np.isfinite(x), x, np.nan)


def snap(x: np.ndarray, bits: int) -> np.ndarray:
    size = np.ldexp(1.0, np.maximum(np.frexp(np.where(np.isnan(x), 1.0, x))[1] - 1, 0))
    return np.floor(x / size * float(1 << bits) + 0.3) * size / float(1 << bits)


def _compare(f):
    return lambda a, b: np.where(np.isnan(a) | np.isnan(b), np.nan, f(a, b))


def _power(a, b):
    return np.where(np.isnan(a) | np.isnan(b), np.nan, fin(np.power(a, b)))


def _signed_power(a, b):
    return fin(np.where(np.abs(a) == 1, np.sign(a), np.sign(a) * _power(np.abs(a), b)))


ROW = {
    "+": np.add, "-": np.subtract, "*": np.multiply, "neg": np.negative, "/": lambda a, b: fin(np.divide(a, b)), "sdiv": lambda a, b: fin(np.divide(a, b)), "**": _power, "spow": _signed_power,
    "<": _compare(np.less), "<=": _compare(np.less_equal), ">": _compare(np.greater), ">=": _compare(np.greater_equal), "lt": _compare(np.less), "max2": np.maximum, "min2": np.minimum,
    "iff": lambda c, a, b: np.where(np.isnan(c), np.nan, np.where(c == 1, a, b)), "ln": lambda a: fin(np.log(a)), "sqrt": lambda a: fin(np.sqrt(a)), "abs": np.abs, "sgn": np.sign,
}


def _parts(x: np.ndarray, w: int) -> list[np.ndarray]:
    """The windows' oldest values, then the next, ..., at last the newest."""
    return [x[k : len(x) - w + 1 + k] for k in range(w)]


def _fold(f):
    def run(w, x):
        found, *more = _parts(x, w)
        found = found.copy()
        for z in more:
            f(found, z, out=found)
        return found

    return run


_sum, _least, _most = _fold(np.add), _fold(np.minimum), _fold(np.maximum)


def _products(w, a, b):
    """Sums of products of deviations from the windows' means: of ``a``, of both and of ``b``."""
    ma, mb = _sum(w, a) / w, _sum(w, b) / w
    aa, ab, bb = (np.zeros(len(ma)) for _ in range(3))
    for p, q in zip(_parts(a, w), _parts(b, w)):
        p, q = p - ma, q - mb
        aa += p * p
        ab += p * q
        bb += q * q
    return aa, ab, bb


def _corr(w, a, b):
    flat = (_least(w, a) == _most(w, a)) | (_least(w, b) == _most(w, b))
    aa, ab, bb = _products(w, a, b)
    spread = np.sqrt(aa / w) * np.sqrt(bb / w)
    return np.where(flat | (spread == 0), 0.0, ab / w / spread)


def _place(w, x):
    """Average rank of the newest value by the window's length."""
    *older, last = _parts(x, w)
    below, equal = np.zeros(len(last)), np.ones(len(last))
    for z in older:
        below += z < last
        equal += z == last
    return (below + (equal + 1) / 2.0) / float(w)


def _extreme(beyond):
    def run(w, x):
        best, *more = _parts(x, w)
        at = np.ones(len(best))
        for k, z in enumerate(more, 2):
            new = beyond(z, best)
            best, at = np.where(new, z, best), np.where(new, float(k), at)
        return at

    return run


def _decay(w, x):
    return sum(z * (2.0 * k / (w * (w + 1))) for k, z in enumerate(_parts(x, w), 1))


TIME = {
    "sum": _sum, "mean": lambda w, x: _sum(w, x) / w, "tmin": _least, "tmax": _most, "prod": _fold(np.multiply), "decay": _decay, "trank": _place, "argmax": _extreme(np.greater), "argmin": _extreme(np.less), "corr": _corr,
    "std": lambda w, x: np.sqrt(_products(w, x, x)[0] / (w - 1)) if w > 1 else np.full(len(x), np.nan), "cov": lambda w, a, b: _products(w, a, b)[1] / (w - 1) if w > 1 else np.full(len(a), np.nan),
}


def _over_time(name: str, place: np.ndarray, args: list, w: int, bits: int) -> np.ndarray:
    """A window of ``w`` rows, or the value ``w`` rows back; ``place`` is the row's number in its symbol, from 0."""
    n, out = len(place), np.full(len(place), np.nan)
    if name in ("lag", "diff"):
        if n > w:
            out[w:] = args[0][:-w]
        out[place < w] = np.nan
        return out if name == "lag" else args[0] - out
    if not len(place) or place.max() < w - 1:
        return out
    cols = [fin(a) for a in args]
    gaps = np.isnan(sum(cols))
    if name in ("trank", "argmax", "argmin"):
        cols = [snap(c, bits) for c in cols]
    out[w - 1 :] = TIME[name](w, *cols)
    out[place < w - 1] = np.nan
    if gaps.any():
        missing = np.concatenate([[0], np.cumsum(gaps)])
        out[w - 1 :][missing[w:] > missing[:-w]] = np.nan
    return out


def _rank(x: np.ndarray, bits: int) -> np.ndarray:
    """Average rank by count; ``bits``: steps in which values are ranked, 0: as they are."""
    x = snap(fin(x), bits) if bits else fin(x)
    out, at = np.full(len(x), np.nan), np.flatnonzero(~np.isnan(x))
    if len(at):
        order = at[np.argsort(x[at])]
        z = x[order]
        bounds = np.concatenate([[0], np.flatnonzero(z[1:] != z[:-1]) + 1, [len(z)]])
        m = np.diff(bounds)
        out[order] = np.repeat((bounds[:-1] + 1 + (m - 1) / 2.0) / len(z), m)
    return out


def _scale(x: np.ndarray) -> np.ndarray:
    x = fin(x)
    total = np.nansum(np.abs(x))
    return x / total if total else np.full(len(x), np.nan)


def _neutral(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Less the mean of its class; ``codes`` -1: without one."""
    x = fin(x)
    known = ~np.isnan(x) & (codes >= 0)
    sums, counts = (np.bincount(codes[known], v, minlength=codes.max() + 2) for v in (x[known], None))
    with np.errstate(all="ignore"):
        means = sums / counts
    return np.where(known, x - means[codes], np.nan)


CROSS = {"rank": _rank, "scale": _scale, "neut": _neutral}


def _compute(steps: list[Step], columns: dict, outputs: list[str], place: np.ndarray | None, bits: int) -> dict:
    """``columns`` with the steps' results; what no later step and no output needs is dropped."""
    uses, values = Counter(a for s in steps for a in s.args if isinstance(a, str)), dict(columns)
    uses.update(outputs)
    with np.errstate(all="ignore"):
        for s in steps:
            args = [values[a] if isinstance(a, str) else a for a in s.args]
            found = ROW[s.name](*args) if s.name in ROW else CROSS[s.name](*args, *s.rest) if place is None else _over_time(s.name, place, args, lookback(s.rest[-1]), bits)
            values[s.key] = found
            for a in s.args:
                if isinstance(a, str):
                    uses[a] -= 1
                    if not uses[a]:
                        del values[a]
    return values


def _read(steps: list[Step], outputs: list[str]) -> set[str]:
    return {a for s in steps for a in s.args if isinstance(a, str)} | set(outputs)


def _columns(table: pa.Table, steps: list[Step], outputs: list[str], packed: list[str]) -> dict:
    """What the steps read of a table, classes as codes; ``packed`` names the values of its PACK."""
    classes, read = {s.args[1] for s in steps if s.name == "neut"}, _read(steps, outputs)
    found = {c: _codes(table[c]) if c in classes else table[c].to_numpy().astype(float, copy=False) for c in read & set(table.column_names)}
    if packed:
        values, at = np.empty((len(packed), table.num_rows)), 0
        for rows in table[PACK].chunks:
            values[:, at : at + len(rows)] = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(packed)).T
            at += len(rows)
        found |= {c: values[k] for k, c in enumerate(packed) if c in read}
    return found


def _codes(values: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, -1 for null."""
    return pa.concat_arrays(values.chunks).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _starts(values: pa.ChunkedArray) -> np.ndarray:
    """Where runs of equal values begin."""
    codes = _codes(values)
    return np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])


def _reach(steps: list[Step]) -> int:
    """Rows back that any result can hang on: nested windows add up."""
    back: dict = {}
    for s in steps:
        back[s.key] = max((back.get(a, 0) for a in s.args), default=0) + (lookback(s.rest[-1]) if s.name not in ROW else 0)
    return max(back.values(), default=0)


def over_symbols(df: DataFrame, steps: list[Step], packed: list[str], outputs: list[str], keep: list[str], by: str, order: str, bits: int) -> DataFrame:
    """``keep`` and, as one array PACK of doubles, the ``outputs`` (steps or numbers read) of steps over rows of ``by`` in the order of ``order``.

    Steps read columns of ``df`` and what its PACK holds, named by ``packed``: hundreds of columns are written and read several times as
    slowly as one array.  Ranks and places of extremes in windows take values in steps of ``bits``.
    """
    reach = _reach(steps)

    def run(batches):
        held = None  # the rows of the last symbol that windows reach back to
        for batch in batches:
            if not batch.num_rows:
                continue
            carried = held is not None and held[by][held.num_rows - 1].as_py() == batch[by][0].as_py()
            table = pa.Table.from_batches([held, batch] if carried else [batch])
            skip = held.num_rows if carried else 0
            starts = _starts(table[by])
            place = np.arange(table.num_rows) - np.repeat(starts, np.diff(np.append(starts, table.num_rows)))
            values = _compute(steps, _columns(table, steps, outputs, packed), outputs, place, bits)
            yield _batch(batch, [values[c][skip:] for c in outputs], keep)
            begin = max(int(starts[-1]), table.num_rows - reach)
            held = table.slice(begin).combine_chunks().to_batches()[0] if begin < table.num_rows else None

    return _mapped(df, run, _read(steps, outputs), packed, keep, by, order)


def within_dates(df: DataFrame, steps: list[Step], packed: list[str], outputs: list[str], keep: list[str], by: str, order: str, rows_a_batch: int = 10_000) -> DataFrame:
    """over_symbols() for steps over all rows of ``by``, a date; ``order`` makes sums the same in any layout."""

    def run(batches):
        pending: list = []

        def found():
            table = pa.Table.from_batches(pending)
            values = _compute(steps, _columns(table, steps, outputs, packed), outputs, None, 0)
            rows = table.select(keep)
            at = 0
            for part in rows.to_batches(max_chunksize=rows_a_batch):
                yield _batch(part, [values[c][at : at + part.num_rows] for c in outputs], keep)
                at += part.num_rows

        for batch in batches:
            if not batch.num_rows:
                continue
            edges = [*_starts(pa.chunked_array([batch[by]])).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if pending and pending[-1][by][0].as_py() != batch[by][a].as_py():
                    yield from found()
                    pending.clear()
                pending.append(batch.slice(a, b - a))
        if pending:
            yield from found()

    return _mapped(df, run, _read(steps, outputs), packed, keep, by, order)


def _batch(rows: pa.RecordBatch, made: list[np.ndarray], keep: list[str]) -> pa.RecordBatch:
    values = np.empty((rows.num_rows, len(made)))
    for k, column in enumerate(made):
        values[:, k] = column
    ends = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * len(made))
    return pa.RecordBatch.from_arrays([*(rows[c] for c in keep), pa.ListArray.from_arrays(ends, pa.array(values.reshape(-1)))], [*keep, PACK])


def _mapped(df: DataFrame, run, read: set[str], packed: list[str], keep: list[str], by: str, order: str) -> DataFrame:
    """``run`` over the rows of ``df`` in sorted partitions, of a number that is not lowered where rows are narrow: the work is in what they become."""
    spark = df.sparkSession
    ship(spark)
    plain = [c for c in df.columns if c in read and c not in keep and c not in packed]
    rows = df.select(*keep, *plain, *([PACK] if packed else [])).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by).sortWithinPartitions(by, order)
    types = {f.name: f.dataType for f in df.schema.fields}
    return rows.mapInArrow(run, T.StructType([*[T.StructField(c, types[c]) for c in keep], T.StructField(PACK, T.ArrayType(T.DoubleType()))]))
