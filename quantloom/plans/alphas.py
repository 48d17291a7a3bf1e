"""Formulaic alphas over a dense date-by-symbol panel.

A formula's window functions nest, and a window function can't stand inside another, so distinct windowed
sub-expressions become columns in stages: a stage has all that is ready over symbols, or all that is ready
over dates.  Stages of one kind follow each other on the same partitioning, so the shuffles are as few as the
formulas' alternations between symbols and dates, however many formulas are computed together.

Ranks and places of extremes take values in steps of about 1e-12, correlations of 6e-8 (see ``snap``): they hang on the order of values alone, and values
that differ by rounding only are ties.  With ``steps=False`` ranks take values as they are.
"""

from __future__ import annotations

import itertools
import re
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import defined as d
from ..operators import xsection as xs
from ..operators.batches import PACK, ROW, Step, over_symbols, within_dates
from ..operators.joins import attach_classes, dense_grid
from ..operators.long_windows import Long, long_windows
from ..operators.ranks import rank_columns
from ..operators.rolling import Rolling, lookback
from ..sources.scratch import Scratch
from .alpha_formulas import formula, numbers

FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "r": "returns", "cap": "market_cap"}
LEVELS = {"sec": "sector", "ind": "industry", "sub": "subindustry"}
_TS = Rolling("symbol", "date_idx")
# windows of so many rows are merged from blocks, not added up anew for every row
LONG_FROM = 60
_LONG = {"sum": "sum", "mean": "mean", "std": "std", "tmin": "min", "tmax": "max", "prod": "product", "corr": "correlation", "cov": "covariance", "argmax": "argmax", "argmin": "argmin", "decay": "decay"}


class Expr:
    """A shared sub-expression: ``kind`` row, time (a window over a symbol) or cross (a window over a date)."""

    def __init__(self, key: str, kind: str, args: tuple, make):
        self.key, self.kind, self.args, self.make, self.numbers = key, kind, args, make, ()
        self.value: float | None = None  # of a constant
        self.name = key.partition("(")[0]

    def _with(self, name: str, f, *others) -> Expr:
        return row(name, f, self, *others)

    def __add__(self, x):
        return self._with("+", lambda a, b: a + b, x)

    def __sub__(self, x):
        return self._with("-", lambda a, b: a - b, x)

    def __mul__(self, x):
        return self._with("*", lambda a, b: a * b, x)

    def __truediv__(self, x):
        return self._with("/", d.sdiv, x)

    def __pow__(self, x):
        return self._with("**", lambda a, b: d.fin(F.pow(a, b)), x)

    def __radd__(self, x):
        return row("+", lambda a, b: a + b, x, self)

    def __rsub__(self, x):
        return row("-", lambda a, b: a - b, x, self)

    def __rmul__(self, x):
        return row("*", lambda a, b: a * b, x, self)

    def __rtruediv__(self, x):
        return row("/", d.sdiv, x, self)

    def __neg__(self):
        return self._with("neg", lambda a: -a)

    def __lt__(self, x):
        return self._with("<", lambda a, b: a < b, x)

    def __le__(self, x):
        return self._with("<=", lambda a, b: a <= b, x)

    def __gt__(self, x):
        return self._with(">", lambda a, b: a > b, x)

    def __ge__(self, x):
        return self._with(">=", lambda a, b: a >= b, x)


def _expr(x) -> Expr:
    if isinstance(x, Expr):
        return x
    found = Expr(repr(float(x)), "row", (), lambda: F.lit(float(x)))
    found.value = float(x)
    return found


def row(name: str, f, *args) -> Expr:
    args = tuple(map(_expr, args))
    return Expr(f"{name}({','.join(a.key for a in args)})", "row", args, f)


def _windowed(kind: str, name: str, f):
    def build(*args):
        inner = tuple(a for a in args if isinstance(a, Expr))
        rest = [a for a in args if not isinstance(a, Expr)]
        found = Expr(f"{name}({','.join([*(a.key for a in inner), *map(str, rest)])})", kind, inner, lambda *c: f(*c, *rest))
        found.numbers = tuple(rest)
        return found

    return build


def _rank(e: Expr, steps: bool = True) -> Expr:
    bits = 0 if not steps else d.CORRELATION_BITS if e.name == "corr" else d.SNAP_BITS
    found = Expr(f"rank({e.key})", "cross", (e,), lambda x: xs.rank(d.snap(d.fin(x), bits) if bits else x, "date_idx"))
    found.numbers = (bits,)
    return found


def _scope(steps: bool = True) -> dict:
    field = lambda name: Expr(name, "row", (), lambda: F.col(name))
    time = {"lag": _TS.delay, "diff": _TS.delta, "sum": _TS.sum, "mean": _TS.mean, "std": _TS.std, "tmin": _TS.min, "tmax": _TS.max, "prod": _TS.product, "corr": _TS.correlation, "cov": _TS.covariance, "trank": lambda x, w: _TS.rank(d.snap(x), w), "argmax": lambda x, w: _TS.argmax(d.snap(x), w), "argmin": lambda x, w: _TS.argmin(d.snap(x), w), "decay": _TS.decay_linear}
    cross = {"scale": lambda x: xs.scale(x, "date_idx"), "neut": lambda x, g: xs.neutralize(x, g, "date_idx")}
    rows = {"sdiv": d.sdiv, "spow": d.signed_power, "lt": d.less, "iff": d.iff, "max2": d.max2, "min2": d.min2, "ln": lambda a: d.fin(F.ln(a)), "abs": F.abs, "sgn": F.signum, "sqrt": lambda a: d.fin(F.sqrt(a))}
    scope = {k: field(v) for k, v in (FIELDS | LEVELS).items()}
    scope |= {k: _windowed("time", k, f) for k, f in time.items()} | {k: _windowed("cross", k, f) for k, f in cross.items()}
    scope |= {k: (lambda *a, k=k, f=f: row(k, f, *a)) for k, f in rows.items()}
    scope["rank"] = lambda e: _rank(e, steps)
    for n in {int(m) for k in numbers() for m in re.findall(r"adv(\d+)", formula(k))}:
        scope[f"adv{n}"] = scope["mean"](scope["v"], n)
    return scope


def build(number: int, steps: bool = True) -> Expr:
    """A formula's expression; its text holds calls and arithmetic only and comes from this package."""
    return eval(formula(number), {"__builtins__": {}}, _scope(steps))  # noqa: S307


def _column(e: Expr, done: dict[str, str]) -> Column:
    if e.key in done:
        return F.col(done[e.key])
    return e.make(*[_column(a, done) for a in e.args])


def evaluate(panel: DataFrame, wanted: dict[str, Expr], keep: list[str], scratch: Scratch | None = None, write_every: int = 60, most_sorts: int = 3) -> DataFrame:
    """Add the ``wanted`` expressions to a dense panel (symbol, date_idx and fields).

    With ``scratch``, a table is written after every ``write_every`` columns of windows when the partitioning
    changes: plans stay small and a lost executor costs one stage.
    """
    nodes: dict[str, Expr] = {}

    def collect(e: Expr) -> None:
        if e.key not in nodes:
            for a in e.args:
                collect(a)
            nodes[e.key] = e

    for e in wanted.values():
        collect(e)
    windows = {k: e for k, e in nodes.items() if e.kind != "row"}

    def needs(e: Expr) -> set[str]:
        out: set[str] = set()
        for a in e.args:
            out |= {a.key} if a.kind != "row" else needs(a)
        return out

    need = {k: needs(e) for k, e in windows.items()}
    last = set().union(*(({e.key} if e.kind != "row" else needs(e)) for e in wanted.values())) if wanted else set()
    done: dict[str, str] = {}
    kind, count, tables = "time", 0, 0
    while len(done) < len(windows):
        ready = [k for k, e in windows.items() if k not in done and e.kind == kind and need[k] <= done.keys()]
        if not ready:
            kind = "cross" if kind == "time" else "time"
            if scratch is not None and count >= write_every:
                panel, count, tables = scratch.write(panel, f"stage-{tables}"), 0, tables + 1
            continue
        ranked, long = [k for k in ready if windows[k].name == "rank"], []
        if len(ranked) > most_sorts:
            ready = ranked
        elif kind == "time":
            long = [k for k in ready if windows[k].name in _LONG and lookback(windows[k].numbers[-1]) >= LONG_FROM]
            ready = long or ready
        names = {k: f"__w{len(done) + i}" for i, k in enumerate(ready)}
        after = done | names
        alive = last.union(*(need[k] for k in windows if k not in after))
        kept = [c for c in panel.columns if not c.startswith("__w") or any(done.get(k) == c for k in alive)]
        if len(ranked) > most_sorts:
            if scratch is not None and count:  # read twice from here on
                panel, count, tables = scratch.write(panel, f"stage-{tables}"), 0, tables + 1
            panel = rank_columns(panel, {n: _column(windows[k].args[0], done) for k, n in names.items()}, "date_idx", "symbol", {n: windows[k].numbers[0] for k, n in names.items()})
            panel = panel.select(*kept, *names.values())
        elif long:
            asked = {n: (windows[k], [_column(a, done) for a in windows[k].args]) for k, n in names.items()}
            panel = long_windows(panel, {n: Long(_LONG[e.name], d.snap(c[0]) if e.name.startswith("arg") else c[0], e.numbers[-1], c[1] if len(c) > 1 else None) for n, (e, c) in asked.items()}, "symbol", "date_idx")
            panel = panel.select(*kept, *names.values())
        else:
            panel = panel.select(*kept, *[_column(windows[k], done).alias(n) for k, n in names.items()])
        done, count = after, count + len(ready)
    return panel.select(*keep, *[d.fin(_column(e, done)).alias(name) for name, e in wanted.items()])


def evaluate_together(panel: DataFrame, wanted: dict[str, Expr], keep: list[str]) -> DataFrame:
    """evaluate() for many expressions: a stage, all that can be done over symbols or all within dates, is one shuffle and one pass in Arrow batches.

    What a stage hands on are the largest sub-expressions that are done, so finished formulas are one column each.
    """
    have, packed = set(panel.columns), []  # expressions that are done
    kept, keep = keep, list(dict.fromkeys([*keep, "symbol", "date_idx"]))
    for kind in itertools.cycle(("time", "cross")):
        known: dict[str, bool] = {}
        found: list[str] = []
        steps: dict[str, Step] = {}

        def can(e: Expr) -> bool:
            if e.key not in known:
                known[e.key] = e.key in have or e.value is not None or (bool(e.args) and e.kind in ("row", kind) and all([can(a) for a in e.args]))
            return known[e.key]

        def work(e: Expr) -> str | float:
            if e.value is not None:
                return e.value
            if e.key not in have and e.key not in steps:
                args = tuple(map(work, e.args))
                steps[e.key] = Step(e.key, e.name, args, e.numbers)
            return e.key

        def largest(e: Expr) -> None:
            if not can(e):
                for a in e.args:
                    largest(a)
            elif e.value is None:
                found.append(work(e))

        for e in wanted.values():
            largest(e)
        last = all(map(can, wanted.values()))
        if not last and all(s.name in ROW for s in steps.values()):
            continue
        found = list(dict.fromkeys(found))
        classes = [k for k in found if k in LEVELS.values()]
        outputs = [k for k in found if k not in classes]
        if kind == "time":
            panel = over_symbols(panel, [*steps.values()], packed, outputs, [*keep, *classes], "symbol", "date_idx", d.SNAP_BITS)
        else:
            panel = within_dates(panel, [*steps.values()], packed, outputs, [*keep, *classes], "date_idx", "symbol")
        have, packed = set(found), outputs
        if last:
            value = lambda e: F.lit(e.value) if e.value is not None else F.get(PACK, F.lit(packed.index(e.key)))
            return panel.select(*kept, *[d.fin(value(e)).alias(name) for name, e in wanted.items()])


def alpha_neutralization_levels() -> dict[int, tuple[str, ...]]:
    """Class levels that each formula is neutralized by, for those that are."""
    found = {n: tuple(v for k, v in LEVELS.items() if re.search(rf",{k}\)", formula(n))) for n in numbers()}
    return {n: levels for n, levels in found.items() if levels}


def history(chosen=None) -> int:
    """Market dates before its own that a score of the ``chosen`` formulas (all, if None) can hang on: nested windows add up."""
    def back(e: Expr) -> int:
        return max(map(back, e.args), default=0) + (lookback(e.numbers[-1]) if e.kind == "time" else 0)

    return max((back(build(n)) for n in (numbers() if chosen is None else chosen)), default=0)


def _panel(market_df: DataFrame, classifications_df: DataFrame | None, levels: list[str], scratch: Scratch | None = None) -> DataFrame:
    """The dense panel of a market table with the class ``levels``, checked as factor_alpha101() says; written where a ``scratch`` is given."""
    df = market_df.withColumnRenamed("asset_returns", "returns") if "returns" not in market_df.columns else market_df
    missing = [c for c in ("date", "symbol", *FIELDS.values()) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if df.groupBy("date", "symbol").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate (date, symbol) rows")
    panel = dense_grid(df.select("date", "symbol", *[d.fin(c).alias(c) for c in FIELDS.values()]))
    if levels:
        if classifications_df is None or (lost := [c for c in ("symbol", *levels) if c not in classifications_df.columns]):
            raise ValueError(f"classifications lack {levels if classifications_df is None else lost}")
        panel = attach_classes(panel, classifications_df, levels)
    if scratch is not None:
        panel = scratch.write(panel, f"panel-{uuid.uuid4().hex}")
    if levels:
        gap = F.lit(False)
        for c in levels:
            gap = gap | F.col(c).isNull()
        if panel.where(F.col("present") & gap).limit(1).count():
            raise ValueError("an observed row has no class")
    return panel


def factor_alpha101(market_df: DataFrame, classifications_df: DataFrame | None = None, alphas=None, scratch: Scratch | None = None, steps: bool = True) -> DataFrame:
    """``date, symbol, alphaNNN...`` for the observed rows of ``market_df``, sorted by date and symbol.

    ``market_df`` has date, symbol, open, high, low, close, volume, vwap, returns (or asset_returns) and market_cap;
    ``classifications_df`` symbol, optionally date, and the levels that the formulas need.  A lag counts market
    dates, not a symbol's own rows: the panel is made dense first.  Repeated numbers count once; no numbers
    give the keys alone.  ``steps``: ranks take values in steps (see above), else as they are.
    """
    if not isinstance(market_df, DataFrame) or not (classifications_df is None or isinstance(classifications_df, DataFrame)):
        raise TypeError("DataFrames are needed")
    chosen = list(dict.fromkeys(numbers() if alphas is None else alphas))
    if bad := [n for n in chosen if n not in set(numbers())]:
        raise ValueError(f"there are no alphas {bad}")
    levels = [v for v in LEVELS.values() if any(v in alpha_neutralization_levels().get(n, ()) for n in chosen)]
    panel = _panel(market_df, classifications_df, levels, scratch)
    if not chosen:
        return panel.where("present").select("date", "symbol").orderBy("date", "symbol")
    wanted = {f"alpha{n:03d}": build(n, steps) for n in chosen}
    keep = ["date", "symbol", "present"]
    scored = evaluate(panel, wanted, keep) if scratch is None else evaluate_together(panel, wanted, keep)
    return scored.where("present").drop("present").orderBy("date", "symbol")


class Alpha101:
    """Single formulas over one market table and its classes: ``Alpha101(market, classes).alpha(42)``.

    The dense panel with its classes is made once and written where a ``scratch`` is given; each formula is a plan over it.
    """

    def __init__(self, market_df: DataFrame, classifications_df: DataFrame | None = None, scratch: Scratch | None = None, steps: bool = True):
        self.steps = steps
        self.levels = [] if classifications_df is None else [v for v in LEVELS.values() if v in classifications_df.columns]
        self.panel = _panel(market_df, classifications_df, self.levels, scratch)
        self.scratch = scratch

    def alpha(self, number: int) -> DataFrame:
        """``date, symbol, alphaNNN`` for the observed rows; a number outside 1 to 101 or a missing level is an error."""
        if number not in set(numbers()):
            raise ValueError(f"there is no alpha {number}")
        if lost := [v for v in alpha_neutralization_levels().get(number, ()) if v not in self.levels]:
            raise ValueError(f"classifications lack {lost}")
        return evaluate(self.panel, {f"alpha{number:03d}": build(number, self.steps)}, ["date", "symbol", "present"], self.scratch).where("present").drop("present")
