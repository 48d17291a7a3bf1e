"""Statistics across alphas: metrics, pairwise correlations, regressions, densities."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import fin


def ols(df: DataFrame, y: str, features: list[str], model: str) -> DataFrame:
    """Least squares with inference, one row per term, over rows where all columns are defined.

    Spark sums the second moments and, in a second pass, the residuals; the driver solves a system of
    ``len(features) + 1`` unknowns.
    """
    columns = [y, *features]
    clean = df.select(*[fin(c).alias(f"c{k}") for k, c in enumerate(columns)]).dropna()
    x = [F.lit(1.0), *[F.col(f"c{k + 1}") for k in range(len(features))]]
    sums = clean.agg(F.count("*").alias("n"), F.avg("c0").alias("mean"), F.array(*[F.sum(a * b) for a in x for b in x]).alias("xx"), F.array(*[F.sum(a * F.col("c0")) for a in x]).alias("xy")).first()
    n, p = sums["n"], len(x)
    if not n:
        return df.sparkSession.createDataFrame([], _OLS)
    inverse = np.linalg.pinv(np.array(sums["xx"], float).reshape(p, p))
    beta = inverse @ np.array(sums["xy"], float)
    fit = sum((F.lit(float(b)) * a for a, b in zip(x, beta)), F.lit(0.0))
    rss, tss = clean.agg(F.sum((F.col("c0") - fit) ** 2), F.sum((F.col("c0") - F.lit(float(sums["mean"]))) ** 2)).first()
    free = n - p
    variance = rss / free if free > 0 else None
    errors = [None if variance is None else float(np.sqrt(max(variance * inverse[k, k], 0.0))) for k in range(p)]
    r2 = 1 - rss / tss if tss > 0 else None
    adjusted = 1 - (1 - r2) * (n - 1) / free if free > 0 and r2 is not None else None
    f = ((tss - rss) / (p - 1)) / (rss / free) if p > 1 and free > 0 and rss > 0 else None
    rows = [(model, t, float(b), e, float(b) / e if e else None, n, r2, adjusted, f) for t, b, e in zip(["intercept", *features], beta, errors)]
    return df.sparkSession.createDataFrame(rows, _OLS)


_OLS = "model string, term string, estimate double, standard_error double, t_statistic double, observations long, r_squared double, adjusted_r_squared double, f_statistic double"


def pair_correlations(daily: DataFrame, least: int = 3) -> DataFrame:
    """``alpha_i, alpha_j, observations, correlation`` of daily PnL for j before i by name, over their common dates.

    Alphas of one date meet in one row of at most 101 entries, which is expanded into pairs.  Count, means and centred products of
    a pair are one aggregate that merges part results, so each task hands on a row a pair and no pair's days are
    sorted or gathered.  PnL is first divided by the alpha's largest, so huge values don't overflow.
    """
    known = daily.select("date", "alpha", fin("pnl").alias("pnl")).dropna()
    largest = known.groupBy("alpha").agg(F.max(F.abs("pnl")).alias("most"))
    scaled = known.join(largest, "alpha").select("date", "alpha", F.coalesce(F.try_divide("pnl", "most"), F.lit(0.0)).alias("pnl"))
    values = scaled.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("alpha", "pnl"))).alias("all"))
    later = values.select("all", F.posexplode("all").alias("at", "x")).where("at > 0")
    met = later.select("x", F.explode(F.slice("all", F.lit(1), F.col("at"))).alias("y")).where("y.alpha < x.alpha")
    a, b = F.col("x.pnl"), F.col("y.pnl")
    found = met.groupBy(F.col("x.alpha").alias("alpha_i"), F.col("y.alpha").alias("alpha_j")).agg(F.count("*").alias("observations"), F.covar_pop(a, b).alias("ab"), F.stddev_pop(a).alias("sa"), F.stddev_pop(b).alias("sb"))
    return found.where(F.col("observations") >= least).select("alpha_i", "alpha_j", "observations", F.try_divide("ab", F.col("sa") * F.col("sb")).alias("correlation")).where("correlation is not null")


def paper_metrics(summary: DataFrame, annualization: int = 252) -> DataFrame:
    needed = ["alpha", "annual_return", "annual_volatility", "sharpe", "paper_turnover", "cents_per_share"]
    if missing := [c for c in needed if c not in summary.columns]:
        raise ValueError(f"summary lacks {missing}")
    metrics = summary.select("alpha", "sharpe", F.col("paper_turnover").alias("turnover"), "cents_per_share", (F.col("annual_volatility") / float(annualization) ** 0.5).alias("daily_volatility"), (F.col("annual_return") / annualization).alias("daily_return"), "annual_return", F.ln(fin("paper_turnover")).alias("log_turnover"))
    centre = metrics.agg(F.coalesce(F.avg(fin("log_turnover")), F.lit(0.0)).alias("__m"))
    return metrics.join(F.broadcast(centre)).select("*", (F.col("log_turnover") - F.col("__m")).alias("centered_log_turnover")).drop("__m")


def analyze_alpha101_paper(summary: DataFrame, daily: DataFrame, annualization: int = 252) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(metrics, pairs, regressions) of a backtest with prices."""
    if missing := [c for c in ("date", "alpha", "pnl") if c not in daily.columns]:
        raise ValueError(f"daily lacks {missing}")
    metrics = paper_metrics(summary, annualization)
    load = metrics.select("alpha", "centered_log_turnover")
    pairs = pair_correlations(daily).join(load.withColumnsRenamed({"alpha": "alpha_i", "centered_log_turnover": "__i"}), "alpha_i").join(load.withColumnsRenamed({"alpha": "alpha_j", "centered_log_turnover": "__j"}), "alpha_j")
    pairs = pairs.select("alpha_i", "alpha_j", "observations", "correlation", (F.col("__i") + F.col("__j")).alias("turnover_sum"), (F.col("__i") * F.col("__j")).alias("turnover_product"))
    tensors = ols(pairs, "correlation", ["turnover_sum", "turnover_product"], "correlation_on_turnover_tensors")
    beta = {r["term"]: r["estimate"] for r in tensors.collect()}
    mean = pairs.agg(F.avg("correlation").alias("__m"))
    pairs = pairs.join(F.broadcast(mean)).withColumns({"demeaned_correlation": F.col("correlation") - F.col("__m"), "turnover_model_contribution": F.lit(beta.get("turnover_sum", 0.0)) * F.col("turnover_sum") + F.lit(beta.get("turnover_product", 0.0)) * F.col("turnover_product")}).drop("__m")
    volatile = metrics.where("daily_volatility > 0 and turnover > 0").select("daily_return", F.ln("daily_volatility").alias("log_volatility"), F.ln("turnover").alias("log_turnover"))
    earning = volatile.where("daily_return > 0").withColumn("log_return", F.ln("daily_return"))
    fits = [ols(earning, "log_return", ["log_volatility"], "log_return_on_log_volatility"), ols(earning, "log_return", ["log_volatility", "log_turnover"], "log_return_on_log_volatility_and_turnover"), tensors, ols(volatile, "log_volatility", ["log_turnover"], "log_volatility_on_log_turnover")]
    regressions = fits[0]
    for fit in fits[1:]:
        regressions = regressions.union(fit)
    return metrics, pairs, regressions


def gaussian_kde(df: DataFrame, column: str, points: int = 300) -> DataFrame:
    """``x, density`` on an even grid three bandwidths beyond the values; bandwidth 0.9 * min(sd, IQR / 1.34) * n**-0.2.

    No values give (0, 0); one distinct value gives a spike at it.
    """
    values = df.select(fin(column).alias("v")).dropna()
    s = values.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.percentile("v", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).first()
    make = lambda rows: df.sparkSession.createDataFrame(rows, "x double, density double")
    if not s["n"]:
        return make([(0.0, 0.0)])
    if s["lo"] == s["hi"]:
        return make([(s["lo"] - 1e-6, 0.0), (s["lo"], 1.0), (s["lo"] + 1e-6, 0.0)])
    spread = min(s["sd"], (s["q"][1] - s["q"][0]) / 1.34)
    width = 0.9 * (spread if spread > 0 else s["sd"]) * s["n"] ** -0.2
    first, step = s["lo"] - 3 * width, (s["hi"] - s["lo"] + 6 * width) / (points - 1)
    at = F.lit(first) + F.col("i") * F.lit(step)
    spots = values.select("v", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    return spots.groupBy("i").agg((F.avg(F.exp(-0.5 * ((at - F.col("v")) / width) ** 2)) / (width * (2 * np.pi) ** 0.5)).alias("density")).select(at.alias("x"), "density")


def composite(daily: DataFrame) -> DataFrame:
    """``date, pnl, wealth, drawdown`` of equal weights over the alphas that have a PnL on the date."""
    mean = daily.groupBy("date").agg(F.avg(fin("pnl")).alias("pnl")).where("pnl is not null")
    over = W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)  # one row per date
    wealth = mean.withColumn("wealth", F.product(1.0 + F.col("pnl")).over(over))
    return wealth.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(over) - 1.0)


def alpha_paths(daily: DataFrame) -> DataFrame:
    """``date, alpha, pnl, wealth, drawdown`` of every alpha over its own dates; a missing PnL is passed over."""
    over = W.partitionBy("alpha").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    wealth = daily.select("date", "alpha", fin("pnl").alias("pnl")).dropna().withColumn("wealth", F.product(1.0 + F.col("pnl")).over(over))
    return wealth.withColumn("drawdown", F.try_divide("wealth", F.max("wealth").over(over)) - 1.0)


def wide(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """One row for each ``row``, a column for each of ``columns`` (as given, so no job looks for them) with ``value``; absent cells are NULL.

    Of repeated cells the largest value counts; NULL rows are a row, values of other columns are left out.
    """
    if row in columns or len(set(columns)) < len(columns):
        raise ValueError("columns must differ from each other and from the row's")
    return df.groupBy(row).agg(*[F.max(F.when(F.col(column) == c, F.col(value))).alias(c) for c in columns])


def largest(df: DataFrame, value: str, n: int = 30) -> DataFrame:
    """The ``n`` rows with the largest absolute ``value``, largest first; ties by the other columns, an undefined value never."""
    rest = [F.col(c) for c in df.columns if c != value]
    return df.where(fin(value).isNotNull()).orderBy(F.abs(F.col(value)).desc(), *rest).limit(n)


def weights_by_sector(weights: DataFrame, classes: DataFrame, most_symbols: int = 80) -> DataFrame:
    """Weights as they are for up to ``most_symbols`` symbols, else summed by sector: alpha, name, weight."""
    if weights.select("symbol").distinct().count() <= most_symbols:
        return weights.select("alpha", F.col("symbol").alias("name"), "weight")
    sectors = classes.groupBy("symbol").agg(F.max("sector").alias("sector"))
    return weights.join(sectors, "symbol", "left").groupBy("alpha", F.col("sector").alias("name")).agg(F.sum("weight").alias("weight"))
