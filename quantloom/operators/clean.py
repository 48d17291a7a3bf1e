"""Cleaning of feature columns."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.defined import fin
from .rolling import Rolling


def _check(df: DataFrame, columns) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError("a DataFrame is needed")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def fill_features(df: DataFrame, features: tuple[str, ...], sort_col: str, over_col: str) -> DataFrame:
    """Features as doubles; NaN, infinities and NULLs take the group's last defined value.  Sorted by ``sort_col``."""
    _check(df, (*features, sort_col, over_col))
    rolling = Rolling(over_col, sort_col)
    return df.withColumns({c: rolling.forward_fill(c) for c in features}).orderBy(sort_col)


def smooth_features(df: DataFrame, features: tuple[str, ...], sort_col: str, over_col: str, window_size: int) -> DataFrame:
    """Features as rolling means over ``window_size`` rows of a group, NULL until the window is full of defined values."""
    _check(df, (*features, sort_col, over_col))
    rolling = Rolling(over_col, sort_col)
    return df.withColumns({c: rolling.mean(fin(c), window_size) for c in features}).orderBy(sort_col)
