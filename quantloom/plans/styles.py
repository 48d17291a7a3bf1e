"""Momentum, size and value scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.defined import fin
from ..functions.weights import exp_weights
from ..operators.carried_windows import Carried, carried_windows
from ..operators.rolling import Rolling
from ..operators.xsection import center_xsection, mask_middle, winsorize_xsection

CARRIED_FROM = 40


def _need(df: DataFrame, *columns: str) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def factor_mom(returns_df: DataFrame, trailing_days: int = 504, half_life: int = 126, lag: int = 20, winsor_factor: float = 0.01) -> DataFrame:
    """``date, symbol, mom_score``: lagged, exponentially weighted compound return, winsorized and standardized by date."""
    _need(returns_df, "date", "symbol", "asset_returns")
    weights = exp_weights(trailing_days, half_life)
    if trailing_days >= CARRIED_FROM:  # an array of every window would be as many values a row
        moved = carried_windows(returns_df.select("date", "symbol", "asset_returns"), {"mom_score": Carried("weighted_product", "asset_returns", trailing_days, weights, lag)})
        raw = moved.select("date", "symbol", fin("mom_score").alias("mom_score"))
    else:
        rolling = Rolling()
        lagged = returns_df.select("date", "symbol", rolling.delay(fin("asset_returns"), lag).alias("r") if lag else fin("asset_returns").alias("r"))
        raw = lagged.select("date", "symbol", fin(rolling.weighted_product("r", weights)).alias("mom_score"))
    return winsorize_xsection(raw, ["mom_score"], "date", winsor_factor).withColumn("mom_score", center_xsection("mom_score", "date", True))


def factor_sze(mkt_cap_df: DataFrame, lower_decile: float = 0.2, upper_decile: float = 0.8) -> DataFrame:
    """``date, symbol, sze_score``: standardized negative log capitalization, 0 between the two quantiles."""
    _need(mkt_cap_df, "date", "symbol", "market_cap")
    scored = mkt_cap_df.select("date", "symbol", fin(-F.ln(fin("market_cap"))).alias("sze_score")).withColumn("sze_score", center_xsection("sze_score", "date", True))
    return mask_middle(scored, "sze_score", "date", lower_decile, upper_decile, 0.0)


def factor_val(value_df: DataFrame, winsorize_features: float | None = None) -> DataFrame:
    """``date, symbol, val_score``: standardized mean of standardized log book, log sales and cash-flow yield.

    Any ``winsorize_features`` other than None turns winsorizing on, always at 0.05.
    """
    features = ["book_price", "sales_price", "cf_price"]
    _need(value_df, "date", "symbol", *features)
    df = value_df.select("date", "symbol", *features)
    if winsorize_features is not None:
        df = winsorize_xsection(df, features, "date")
    logs = df.withColumns({c: fin(F.ln(fin(c))) for c in features[:2]} | {"cf_price": fin("cf_price")})
    scores = logs.withColumns({c: center_xsection(c, "date", True) for c in features})
    known = sum((F.col(c).isNotNull().cast("int") for c in features), F.lit(0))
    mean = F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in features), F.lit(0.0)), known)
    return scores.select("date", "symbol", mean.alias("val_score")).withColumn("val_score", center_xsection("val_score", "date", True))
