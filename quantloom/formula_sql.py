"""The formulas as DuckDB SQL, to hold the Spark plans against: every call is a column of a common table of its own."""

from __future__ import annotations

import ast

from .functions.defined import CORRELATION_BITS, SNAP_BITS
from .plans.alpha_formulas import formula

FIELDS = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vw": "vwap", "r": "returns", "cap": "market_cap", "sec": "sector", "ind": "industry", "sub": "subindustry"}
_SERIES, _DAY = "PARTITION BY symbol ORDER BY date_idx", "PARTITION BY date_idx"
_OPS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">="}
_TOTALS = {"sum": "sum", "mean": "avg", "std": "stddev_samp", "tmin": "min", "tmax": "max", "prod": "product"}


class Tables:
    """Common tables t1, t2, ... over ``g`` (symbol, date_idx, fields and classes), a column added by each."""

    def __init__(self):
        self.tables: list[str] = []
        self.names: dict[str, str] = {}

    def column(self, x: str) -> str:
        if x not in self.names:
            n = len(self.tables) + 1
            self.names[x] = f"x{n}"
            self.tables.append(f"t{n} AS (SELECT *, {x} AS x{n} FROM {f't{n - 1}' if n > 1 else 'g'})")
        return self.names[x]

    def finite(self, x: str) -> str:
        x = self.column(x)
        return self.column(f"CASE WHEN isfinite({x}) THEN {x} END")

    def full(self, x: str, w: int, value: str) -> str:
        frame = f"({_SERIES} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        return self.column(f"CASE WHEN count({x}) OVER {frame} = {w} THEN {value.replace('@', f' OVER {frame}')} END")

    def snap(self, x: str, bits: int) -> str:
        size = self.column(f"CASE WHEN abs({x}) >= 1 THEN power(2, floor(log2(abs({x})))) ELSE 1.0 END")
        return self.column(f"floor({x} / {size} * {float(1 << bits)!r} + 0.3) * {size} / {float(1 << bits)!r}")

    def call(self, name: str, x: list[str], w: int, bits: int = SNAP_BITS) -> str:
        a, b = x[0], x[1] if len(x) > 1 else ""
        if name in ("trank", "argmax", "argmin", "rank"):
            a = self.snap(a, bits)
        if name in _TOTALS:
            return self.full(a, w, f"{_TOTALS[name]}({a})@")
        if name == "cov":
            return self.full(f"{a} + {b}", w, f"covar_samp({a}, {b})@")
        if name == "corr":
            return self.full(f"{a} + {b}", w, f"CASE WHEN min({a})@ = max({a})@ OR min({b})@ = max({b})@ THEN 0 ELSE coalesce(covar_pop({a}, {b})@ / nullif(stddev_pop({a})@ * stddev_pop({b})@, 0), 0) END")
        if name in ("lag", "diff"):
            return self.column(("" if name == "lag" else f"{a} - ") + f"lag({a}, {w}) OVER ({_SERIES})")
        if name in ("trank", "argmax", "argmin", "decay"):
            z = self.full(a, w, f"list({a})@")
            if name == "trank":
                return self.column(f"(len(list_filter({z}, lambda v: v < {a})) + (len(list_filter({z}, lambda v: v = {a})) + 1) / 2.0) / {w}")
            if name == "decay":
                return self.column(f"list_sum(list_transform({z}, lambda v, i: v * i)) * 2.0 / {w * (w + 1)}")
            return self.column(f"CAST(list_position({z}, list_{name[3:]}({z})) AS DOUBLE)")
        if name == "rank":
            return self.column(f"CASE WHEN {a} IS NOT NULL THEN (rank() OVER ({_DAY} ORDER BY {a} NULLS LAST) + (count(*) OVER ({_DAY}, {a}) - 1) / 2.0) / count({a}) OVER ({_DAY}) END")
        if name == "scale":
            return self.column(f"{a} / nullif(sum(abs({a})) OVER ({_DAY}), 0)")
        if name == "neut":
            return self.column(f"CASE WHEN {b} IS NOT NULL THEN {a} - avg({a}) OVER ({_DAY}, {b}) END")
        if name == "sdiv":
            return self.finite(f"{a} / nullif({b}, 0)")
        if name == "spow":
            return self.finite(f"CASE WHEN abs({a}) = 1 THEN sign({a}) ELSE sign({a}) * pow(abs({a}), {b}) END")
        if name in ("ln", "sqrt"):
            return self.column(f"CASE WHEN {a} {'>' if name == 'ln' else '>='} 0 THEN {name}({a}) END")
        if name in ("max2", "min2"):
            return self.column(f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN {'greatest' if name == 'max2' else 'least'}({a}, {b}) END")
        if name == "lt":
            return self.column(f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN {a} < {b} THEN 1.0 ELSE 0.0 END")
        if name == "iff":
            return self.column(f"CASE WHEN ({a}) IS NULL THEN NULL WHEN {a} THEN {b} ELSE {x[2]} END")
        return self.column({"abs": f"abs({a})", "sgn": f"CAST(sign({a}) AS DOUBLE)"}[name])

    def sql(self, e: ast.expr) -> str:
        if isinstance(e, ast.Constant):
            return f"CAST({e.value!r} AS DOUBLE)"
        if isinstance(e, ast.Name):
            return self.call("mean", ["volume"], int(e.id[3:])) if e.id.startswith("adv") else FIELDS[e.id]
        if isinstance(e, ast.UnaryOp):
            return f"(-{self.sql(e.operand)})"
        if isinstance(e, ast.Compare):
            return f"({self.sql(e.left)} {_OPS[type(e.ops[0])]} {self.sql(e.comparators[0])})"
        if isinstance(e, ast.Call):
            windowed = e.func.id not in ("spow", "sdiv", "lt", "max2", "min2", "iff", "ln", "abs", "sgn", "sqrt", "rank", "scale", "neut")
            args = [self.sql(a) for a in (e.args[:-1] if windowed else e.args)]
            args = [x if x.isidentifier() or e.func.id == "iff" else self.column(x) for x in args]
            of_corr = e.func.id == "rank" and isinstance(e.args[0], ast.Call) and e.args[0].func.id == "corr"
            return self.call(e.func.id, args, int(e.args[-1].value) if windowed else 0, CORRELATION_BITS if of_corr else SNAP_BITS)
        a, b = self.sql(e.left), self.sql(e.right)
        if isinstance(e.op, ast.Pow):
            return self.finite(f"pow({a}, {b})")
        if isinstance(e.op, ast.Div):
            return self.finite(f"{a} / nullif({b}, 0)")
        return f"({a} {_OPS[type(e.op)]} {b})"


def formulas_sql(numbers: list[int], head: str, rounded) -> str:
    """``head`` ends in ``g``; ``rounded(sql, name)`` gives a result column."""
    t = Tables()
    found = {n: t.finite(t.sql(ast.parse(formula(n), mode="eval").body)) for n in numbers}
    return f"WITH {head}, {', '.join(t.tables)} SELECT date, symbol, {', '.join(rounded(x, f'alpha{n:03d}') for n, x in found.items())} FROM t{len(t.tables)} WHERE present"
