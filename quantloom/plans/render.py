"""Markdown reports from small result tables (at most one row per alpha, pair statistic or regression term)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cell(value) -> str:
    return "n/a" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, columns: list[str], most: int = 200) -> str:
    rows = df.select(*columns).limit(most).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(_cell(v) for v in r) + " |" for r in rows])


def render_alpha101_report(summary: DataFrame, top: int = 10) -> str:
    """Overview and the best and worst alphas by Sharpe ratio, undefined ones last."""
    ordered = ["alpha", "days", "annual_return", "annual_volatility", "sharpe", "max_drawdown", "mean_ic", "mean_rank_ic", "mean_turnover"]
    s = summary.agg(F.count("*").alias("n"), F.median("annual_return").alias("r"), F.median("sharpe").alias("s"), F.median("mean_rank_ic").alias("i"), F.median("mean_turnover").alias("t"), F.count_if(F.col("sharpe") > 0).alias("p")).first()
    best, worst = summary.orderBy(F.col("sharpe").desc_nulls_last(), "alpha").limit(top), summary.where("sharpe is not null").orderBy("sharpe", "alpha").limit(top)
    head = [("alphas", s["n"]), ("positive Sharpe", s["p"]), ("median annual return", s["r"]), ("median Sharpe", s["s"]), ("median rank IC", s["i"]), ("median turnover", s["t"])]
    return "\n\n".join(["# Alpha analysis", "\n".join(f"- {k}: {_cell(v)}" for k, v in head), "## Highest Sharpe", markdown_table(best, ordered), "## Lowest Sharpe", markdown_table(worst, ordered)]) + "\n"


def render_alpha101_paper_report(metrics: DataFrame, pairs: DataFrame, regressions: DataFrame) -> str:
    """Pair statistics and regressions."""
    c = pairs.agg(F.count("*").alias("n"), F.avg("correlation").alias("m"), F.median("correlation").alias("d")).first()
    head = [("alphas", metrics.count()), ("pairs", c["n"]), ("mean correlation", c["m"]), ("median correlation", c["d"])]
    return "\n\n".join(["# Statistics across alphas", "\n".join(f"- {k}: {_cell(v)}" for k, v in head), "## Regressions", markdown_table(regressions, regressions.columns)]) + "\n"
