"""Constrained, capitalization-weighted factor returns per date."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.defined import fin
from ..operators.xsection import winsorize_xsection
from ..shipping import ship


def gram(df: DataFrame, left: list[Column], right: list[Column], weight: Column, by: str = "date", name: str = "gram") -> DataFrame:
    """Per group the flattened matrix of sums of weight * left * right: one small row, combined before the shuffle."""
    return df.groupBy(by).agg(F.array(*[F.sum(weight * a * b) for a in left for b in right]).alias(name))


def _matrices(r: np.ndarray, k_sectors: int, k_styles: int):
    width = 1 + k_sectors + k_styles + 1
    g = r.reshape(width, width)
    return g, slice(0, 1 + k_sectors), slice(1 + k_sectors, width - 1), width - 1


def solve(gram_row, k_sectors: int, k_styles: int, residualize: bool) -> np.ndarray:
    """Market, sector and style returns of one date from its weighted second moments of (1, sectors, styles, return).

    Sector returns add up to 0: the last is minus the sum of the others, by a change of variables.  Styles
    are fitted to what market and sectors leave (or to the returns).  Rank-deficient systems get
    the solution of least norm.
    """
    g, x, z, r = _matrices(np.asarray(gram_row, float), k_sectors, k_styles)
    if k_sectors:
        change = np.zeros((1 + k_sectors, k_sectors))
        change[:k_sectors, :k_sectors] = np.eye(k_sectors)
        change[k_sectors, 1:] = -1.0
    else:
        change = np.eye(1)
    base = change @ (np.linalg.pinv(change.T @ g[x, x] @ change) @ (change.T @ g[x, r]))
    if not k_styles:
        return base
    target = g[z, r] - g[z, x] @ base if residualize else g[z, r]
    return np.concatenate([base, np.linalg.pinv(g[z, z]) @ target])


def factor_returns(panel: DataFrame, sectors: list[str], styles: list[str], residualize_styles: bool = True) -> tuple[DataFrame, DataFrame]:
    """Factor returns (wide) and residuals (long) of a joined panel: date, symbol, asset_returns, market_cap, sectors, styles.

    A row without a defined return, capitalization, sector or style doesn't take part.
    """
    ship(panel.sparkSession)
    names = [*sectors, *styles]
    clean = panel.select("date", "symbol", *[fin(c).alias(c) for c in ("asset_returns", "market_cap", *names)]).dropna()
    terms = [F.lit(1.0), *map(F.col, names), F.col("asset_returns")]
    grams = gram(clean, terms, terms, F.sqrt("market_cap"))
    k, m = len(sectors), len(styles)

    @F.pandas_udf("array<double>")
    def solved(rows: pd.Series) -> pd.Series:
        return rows.map(lambda g: solve(g, k, m, residualize_styles).tolist())

    fitted = grams.select("date", solved("gram").alias("f"))
    wide = fitted.select(*[F.col("f")[i].alias(c) for i, c in enumerate(["market", *names])], "date")
    fit = sum((F.col("f")[i + 1] * F.col(c) for i, c in enumerate(names)), F.col("f")[0])
    residuals = clean.join(fitted, "date").select("date", "symbol", (F.col("asset_returns") - fit).alias("residual"))
    return wide, residuals


def estimate_factor_returns(returns_df: DataFrame, mkt_cap_df: DataFrame, sector_df: DataFrame, style_df: DataFrame, winsor_factor: float | None = 0.05, residualize_styles: bool = True) -> tuple[DataFrame, DataFrame]:
    """(factor returns, residuals): inner joins on (date, symbol), returns winsorized by date, one regression per date.

    Factor returns have columns market, sectors sorted, styles sorted, date.
    """
    frames = {"returns_df": (returns_df, ["asset_returns"]), "mkt_cap_df": (mkt_cap_df, ["market_cap"]), "sector_df": (sector_df, []), "style_df": (style_df, [])}
    for name, (frame, columns) in frames.items():
        if not isinstance(frame, DataFrame):
            raise TypeError(f"{name} must be a DataFrame")
        missing = [c for c in ("date", "symbol", *columns) if c not in frame.columns]
        if missing:
            raise ValueError(f"{name} has no columns {missing}")
    sectors, styles = (sorted(c for c in f.columns if c not in ("date", "symbol")) for f in (sector_df, style_df))
    keys = ["date", "symbol"]
    panel = returns_df.select(*keys, "asset_returns").join(mkt_cap_df.select(*keys, "market_cap"), keys).join(sector_df.select(*keys, *sectors), keys).join(style_df.select(*keys, *styles), keys)
    if winsor_factor is not None:
        panel = winsorize_xsection(panel, ["asset_returns"], "date", winsor_factor)
    return factor_returns(panel, sectors, styles, residualize_styles)
