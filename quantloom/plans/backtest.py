"""Long-short backtest of alpha scores, set by set: no loop over dates or alphas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.defined import fin
from ..operators.rolling import Rolling
from ..operators.xsection import quantile_weights
from ..sources.scratch import Scratch

LEAST_NAMES = 5


def alpha_columns(df: DataFrame) -> list[str]:
    found = sorted(c for c in df.columns if re.fullmatch(r"alpha\d+", c))
    if not found:
        raise ValueError("no alphaNNN columns")
    return found


def _check(scores: DataFrame, quantile: float) -> list[str]:
    if not 0 < quantile <= 0.5:
        raise ValueError("quantile must be in (0, 0.5]")
    if not isinstance(scores, DataFrame):
        raise TypeError("scores must be a DataFrame")
    return alpha_columns(scores)


def long_scores(scores: DataFrame, alphas: list[str], *keep: str) -> DataFrame:
    """One row per date, symbol and alpha."""
    return scores.select("date", "symbol", *keep, F.explode(F.array(*[F.struct(F.lit(a).alias("alpha"), fin(a).alias("score")) for a in alphas])).alias("__s")).select("date", "symbol", *keep, "__s.alpha", "__s.score")


def _average_rank(x: Column, over) -> Column:
    """Among the defined values of ``over``; NULL for the others."""
    ordered = over.orderBy(x.asc_nulls_last())
    return F.when(x.isNotNull(), F.rank().over(ordered) + (F.count(x).over(ordered.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2.0)


def _unit(c: str, over) -> Column:
    """Deviation from the mean by the largest one of the group, so huge values don't overflow and values close to each other keep their digits."""
    x = F.col(c) - F.avg(c).over(over)
    return F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(x, F.greatest(F.max(c).over(over) - F.avg(c).over(over), F.avg(c).over(over) - F.min(c).over(over))), F.lit(0.0)))


def _pearson(x: str, y: str) -> Column:
    """Pearson correlation by merged moments, as an aggregate; NULL where a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _correlation(df: DataFrame, x: str, y: str, keys: tuple[str, ...], name: str) -> DataFrame:
    """Pearson correlation per group, NULL where a side is constant."""
    over = W.partitionBy(*keys)
    return df.withColumns({c: _unit(c, over) for c in (x, y)}).groupBy(*keys).agg(_pearson(x, y).alias(name))


def _positions(scores: DataFrame, returns: DataFrame, alphas: list[str], quantile: float, prices: DataFrame | None) -> DataFrame:
    """Rows of the (date, alpha) cross-sections that count: at least LEAST_NAMES scores and one next return."""
    forward = returns.select("date", "symbol", Rolling().lead(fin("asset_returns")).alias("forward"))
    joined = scores.select("date", "symbol", *alphas).join(forward, ["date", "symbol"])
    keep = ["forward"]
    if prices is not None:
        joined = joined.join(prices.select("date", "symbol", fin("close").alias("price")), ["date", "symbol"], "left")
        keep.append("price")
    over = W.partitionBy("date", "alpha")
    rows = long_scores(joined, alphas, *keep)
    rows = rows.withColumns({"n_rows": F.count("*").over(over), "n_scores": F.count("score").over(over), "n_returns": F.count(F.when(F.col("score").isNotNull(), F.col("forward"))).over(over)})
    rows = rows.where((F.col("n_scores") >= LEAST_NAMES) & (F.col("n_returns") > 0))
    return quantile_weights(rows, "score", ("date", "alpha"), quantile)


def daily_measures(rows: DataFrame) -> DataFrame:
    """PnL, correlations and coverage of each cross-section from one shuffle of its rows.

    Only rows with a score and a forward return have ranks.
    """
    keys = ("date", "alpha")
    over = W.partitionBy(*keys)
    met = (F.col("n_returns") >= LEAST_NAMES) & F.col("score").isNotNull() & F.col("forward").isNotNull()
    pairs = rows.withColumns({"__x": F.when(met, F.col("score")), "__y": F.when(met, F.col("forward"))})
    ranked = pairs.withColumns({"__rx": _average_rank(F.col("__x"), over), "__ry": _average_rank(F.col("__y"), over)})
    scaled = ranked.withColumns({c: _unit(c, over) for c in ("__x", "__y")})
    found = scaled.groupBy(*keys).agg(F.sum(F.col("weight") * F.coalesce("forward", F.lit(0.0))).alias("pnl"), (F.max("n_scores") / F.max("n_rows")).alias("coverage"), (F.max("n_returns") / F.max("n_scores")).alias("return_coverage"), _pearson("__x", "__y").alias("ic"), _pearson("__rx", "__ry").alias("rank_ic"))
    return found.withColumn("k", F.row_number().over(W.partitionBy("alpha").orderBy("date")))


def turnover(held: DataFrame, last: DataFrame) -> DataFrame:
    """Half the absolute change of weights from one counted date to the next, from no position at the start.

    ``held`` has alpha, k, symbol, weight; each weight enters at k and leaves at k + 1.
    """
    moves = held.select("alpha", "k", "symbol", "weight").union(held.select("alpha", F.col("k") + 1, "symbol", -F.col("weight")))
    net = moves.groupBy("alpha", "k", "symbol").agg(F.sum("weight").alias("d")).groupBy("alpha", "k").agg((0.5 * F.sum(F.abs("d"))).alias("turnover"))
    return net.join(last, "alpha").where(F.col("k") <= F.col("last_k")).select("alpha", "k", "turnover")


def share_trades(held: DataFrame, dates: DataFrame, last: DataFrame, prices: DataFrame, keep=lambda df, table: df) -> DataFrame:
    """Shares and dollars traded per alpha and counted date.

    Where a price is positive the target is weight / price, elsewhere the shares before are carried.  A date on
    which a held or wanted name has no price is undefined.

    Only what can change a position has a row: dates with a weight, the date after (the exit), and where an exit meets no price the
    next date that has one.  Between an exit and that date the alpha's dates are undefined; such intervals are marked at their
    two ends and added up along the alpha's dates.  So work goes with trades, not with dates times names times alphas.  ``keep`` may write a table.
    """
    name = ["alpha", "symbol"]
    in_order, ahead = W.partitionBy(*name).orderBy("k"), F.lead("k").over(W.partitionBy(*name).orderBy("k"))
    own = held.select(*name, "k", "weight")
    exits = own.withColumn("then", ahead).where("then is null or then > k + 1").join(last, "alpha").where("k < last_k").select(*name, (F.col("k") + 1).alias("k"), F.lit(0.0).alias("weight"))
    tradable = prices.where("price > 0").select("date", "symbol", "price")
    events = keep(own.unionByName(exits).join(dates, ["alpha", "k"]).join(tradable, ["date", "symbol"], "left").withColumn("then", ahead), "events")
    # exits without a price, and the next date on which the alpha counts and the name has one
    stuck = events.where("weight = 0 and price is null").select(*name, "k", "then")
    days = tradable.join(stuck.select(*name).distinct(), "symbol").join(dates, ["alpha", "date"]).select(*name, "k", F.lit(None).cast(stuck.schema["then"].dataType).alias("then"), "price")
    both = stuck.withColumns({"price": F.lit(None).cast("double"), "stuck": F.lit(True)}).unionByName(days.withColumn("stuck", F.lit(False)))
    later = W.partitionBy(*name).orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, -1)
    freed = both.withColumn("next", F.last(F.when(~F.col("stuck"), F.struct("k", "price")), ignorenulls=True).over(later)).where("stuck")
    freed = freed.select(*name, "k", "then", "next")
    recovered = freed.where("next is not null and (then is null or next.k < then)").select(*name, F.col("next.k").alias("k"), F.lit(0.0).alias("weight"), F.col("next.price").alias("price"))
    line = events.select(*name, "k", "weight", "price").unionByName(recovered)
    target = F.coalesce(F.last(F.when(F.col("price").isNotNull(), F.try_divide("weight", "price")), ignorenulls=True).over(in_order.rowsBetween(W.unboundedPreceding, 0)), F.lit(0.0))
    line = line.withColumn("target", target).withColumn("before", F.coalesce(F.lag("target").over(in_order), F.lit(0.0)))
    traded = F.abs(F.col("target") - F.col("before"))
    missing = ((F.col("weight") != 0) | (F.col("before") != 0)) & F.col("price").isNull()
    sums = line.groupBy("alpha", "k").agg(F.max(missing).alias("bad"), F.sum(traded).alias("s"), F.sum(F.when(F.col("price").isNotNull(), traded * F.col("price")).otherwise(0.0)).alias("d"))
    open_ = line.where((F.col("before") != 0) & (F.col("weight") == 0) & F.col("price").isNull()).select(*name, "k").join(freed, [*name, "k"])
    until = F.least(F.col("next.k"), F.col("then"))  # NULL: to the end
    marks = open_.select("alpha", F.explode(F.array(F.struct(F.col("k").alias("k"), F.lit(1).alias("d")), F.struct(until.alias("k"), F.lit(-1).alias("d")))).alias("m")).where("m.k is not null")
    marks = marks.groupBy("alpha", F.col("m.k").alias("k")).agg(F.sum("m.d").alias("opened"))
    every = dates.join(held.select("alpha").distinct(), "alpha").select("alpha", "k").join(sums, ["alpha", "k"], "left").join(marks, ["alpha", "k"], "left")
    waiting = F.sum(F.coalesce("opened", F.lit(0))).over(W.partitionBy("alpha").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    fine = ~F.coalesce("bad", F.lit(False)) & (F.col("waiting") == 0)
    return every.withColumn("waiting", waiting).select("alpha", "k", F.when(fine, F.coalesce("s", F.lit(0.0))).alias("shares_traded"), F.when(fine, F.coalesce("d", F.lit(0.0))).alias("dollar_volume"))


def _ratio(x: str, annualization: int) -> Column:
    spread = F.stddev_samp(x)
    return F.when(spread > 0, F.try_divide(F.avg(x), spread) * float(annualization) ** 0.5)


def summarize(daily: DataFrame, annualization: int = 252) -> DataFrame:
    """One row per alpha; drawdowns are from the peak of wealth at the end of the days."""
    over = W.partitionBy("alpha").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    wealth = daily.withColumn("__w", F.product(1.0 + F.col("pnl")).over(over))
    drawn = wealth.withColumn("__d", F.try_divide(F.col("__w"), F.max("__w").over(over)) - 1.0)
    mean = lambda c, name: F.avg(c).alias(name)
    found = [F.count("*").alias("days"), (F.avg("pnl") * annualization).alias("annual_return"), (F.stddev_samp("pnl") * float(annualization) ** 0.5).alias("annual_volatility"), _ratio("pnl", annualization).alias("sharpe"), F.min("__d").alias("max_drawdown"), mean("ic", "mean_ic"), _ratio("ic", annualization).alias("ic_ir"), mean("rank_ic", "mean_rank_ic"), _ratio("rank_ic", annualization).alias("rank_ic_ir"), mean("turnover", "mean_turnover"), mean("coverage", "mean_coverage"), mean("return_coverage", "mean_return_coverage")]
    if "dollar_volume" in daily.columns:
        shares = F.avg("shares_traded")
        found += [mean("dollar_volume", "paper_turnover"), F.when(shares > 0, F.try_divide(100.0 * F.avg("pnl"), shares)).alias("cents_per_share")]
    return drawn.groupBy("alpha").agg(*found)


def analyze_alpha101(scores_df: DataFrame, returns_df: DataFrame, quantile: float = 0.2, annualization: int = 252, prices_df: DataFrame | None = None, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, daily): quantile long-short portfolios held over a symbol's next row.

    A (date, alpha) without LEAST_NAMES scores or any next return is passed over and leaves positions as they are.
    Missing returns count as 0.  With prices, share trading is measured too.  With ``scratch`` positions, daily measures and events
    are written, since each is read several times.
    """
    keep = (lambda df, table: df) if scratch is None else scratch.write
    alphas = _check(scores_df, quantile)
    if not isinstance(returns_df, DataFrame) or not (prices_df is None or isinstance(prices_df, DataFrame)):
        raise TypeError("returns and prices must be DataFrames")
    for frame, columns in ((returns_df, ("date", "symbol", "asset_returns")), (prices_df, ("date", "symbol", "close"))):
        if frame is not None and (missing := [c for c in columns if c not in frame.columns]):
            raise ValueError(f"missing columns: {missing}")
    rows = keep(_positions(scores_df, returns_df, alphas, quantile, prices_df), "positions")
    daily = keep(daily_measures(rows), "measures")
    dates = daily.select("alpha", "date", "k")
    last = dates.groupBy("alpha").agg(F.max("k").alias("last_k"))
    held = keep(rows.where("weight != 0").join(dates, ["alpha", "date"]).select("alpha", "k", "symbol", "weight"), "held")
    daily = daily.join(turnover(held, last), ["alpha", "k"], "left").withColumn("turnover", F.coalesce("turnover", F.lit(0.0)))
    columns = ["date", "alpha", "pnl", "ic", "rank_ic", "turnover", "coverage", "return_coverage"]
    if prices_df is not None:
        # prices as the backtest sees them: those of rows that have scores and returns
        seen = scores_df.select("date", "symbol").join(returns_df.select("date", "symbol"), ["date", "symbol"]).join(prices_df.select("date", "symbol", fin("close").alias("price")), ["date", "symbol"])
        daily = daily.join(share_trades(held, dates, last, seen, keep), ["alpha", "k"], "left")
        idle = last.join(held.select("alpha").distinct(), "alpha", "left_anti").select("alpha", F.lit(0.0).alias("__zero"))
        daily = daily.join(idle, "alpha", "left").withColumns({c: F.coalesce(c, "__zero") for c in ("shares_traded", "dollar_volume")})
        columns += ["shares_traded", "dollar_volume"]
    daily = daily.select(*columns)
    return summarize(daily, annualization), daily


def latest_alpha101_weights(scores_df: DataFrame, quantile: float = 0.2) -> DataFrame:
    """``date, alpha, symbol, weight`` at each alpha's latest date with LEAST_NAMES scores; every symbol has a row."""
    alphas = _check(scores_df, quantile)
    rows = long_scores(scores_df, alphas)
    counted = rows.groupBy("alpha", "date").agg(F.count("score").alias("n")).where(F.col("n") >= LEAST_NAMES).groupBy("alpha").agg(F.max("date").alias("date"))
    weighted = quantile_weights(rows.join(counted, ["alpha", "date"]), "score", ("alpha",), quantile).select("alpha", "symbol", "weight")
    every = scores_df.select("symbol").distinct().select("symbol", F.explode(F.array(*map(F.lit, alphas))).alias("alpha")).join(counted, "alpha")
    return every.join(weighted, ["alpha", "symbol"], "left").select("date", "alpha", "symbol", F.coalesce("weight", F.lit(0.0)).alias("weight"))
