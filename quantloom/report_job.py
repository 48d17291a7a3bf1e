"""spark-submit job: landed prices, shares and universe in; scores, backtest, statistics and reports out."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.alphas import factor_alpha101, history
from .plans.backtest import analyze_alpha101, latest_alpha101_weights
from .plans.paper import alpha_paths, analyze_alpha101_paper
from .plans.render import render_alpha101_paper_report, render_alpha101_report
from .sources.ingest import FORMULA_VERSION, build_market_data, checksum, members
from .sources.score_cache import ScoreCache
from .sources.landed import share_files
from .sources.scratch import Scratch


def parse_args(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("prices", "shares", "universe", "output-dir", "cache-dir", "warmup-start", "start", "end"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--quantile", type=float, default=0.2)
    parser.add_argument("--annualization", type=int, default=252)
    parser.add_argument("--refresh-scores", action="store_true")
    parser.add_argument("--alphas", type=lambda text: [int(n) for n in text.split(",")], help="numbers of formulas, parted by commas; all, if left out")
    args = parser.parse_args(argv)
    if not args.warmup_start < args.start < args.end:
        parser.error("warmup-start < start < end is needed")
    return args


def metadata(market: DataFrame, universe: DataFrame, scores: DataFrame, args: argparse.Namespace) -> dict:
    """Constituents, histories found for them, and the dates of the warm-up, the analysis and the last observation."""
    dates = lambda df: df.agg(F.min("date").cast("string"), F.max("date").cast("string"), F.count_distinct("symbol")).first()
    (warm, last, symbols), (first, end, scored) = dates(market), dates(scores)
    return {"constituents": universe.select("symbol").distinct().count(), "histories": symbols, "share_histories": market.where("market_cap is not null").select("symbol").distinct().count(), "scored": scored, "warmup_start": warm, "analysis_start": first, "analysis_end": end, "last_observation": last, "end_exclusive": args.end}


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    """Dates from ``warmup_start`` to before ``end``; scores from ``start`` on, of which a later run computes only what has changed."""
    read = spark.read.parquet
    market = build_market_data(read(args.prices), share_files(spark, args.shares)).where((F.col("date") >= args.warmup_start) & (F.col("date") < args.end))
    universe = spark.read.csv(args.universe, header=True)
    scratch = Scratch(spark, "report")
    market = scratch.write(members(market, universe), "market")
    basis = json.dumps([FORMULA_VERSION, args.alphas, checksum(universe)])
    cache = ScoreCache(spark, f"{args.cache_dir}/scores")
    scores = cache.refresh(market, lambda rows: factor_alpha101(rows, universe, args.alphas, scratch), history(args.alphas), basis, scratch, args.start, args.refresh_scores)
    returns, prices = market.select("date", "symbol", F.col("returns").alias("asset_returns")), market.select("date", "symbol", F.col("execution_price").alias("close"))
    summary, daily = analyze_alpha101(scores, returns, args.quantile, args.annualization, prices, scratch)
    summary, daily = scratch.write(summary, "summary"), scratch.write(daily, "daily")
    metrics, pairs, regressions = analyze_alpha101_paper(summary, daily, args.annualization)
    texts = {"alpha_analysis.md": render_alpha101_report(summary), "alpha_statistics.md": render_alpha101_paper_report(metrics, pairs, regressions), "metadata.json": json.dumps(metadata(market, universe, scores, args))}
    for name, frame in {"summary": summary, "metrics": metrics, "pairs": pairs, "regressions": regressions}.items():
        frame.coalesce(1).write.mode("overwrite").csv(f"{args.output_dir}/{name}.csv", header=True)
    alpha_paths(daily).write.mode("overwrite").parquet(f"{args.output_dir}/paths.parquet")
    daily.write.mode("overwrite").parquet(f"{args.output_dir}/daily.parquet")
    latest_alpha101_weights(scores, args.quantile).write.mode("overwrite").parquet(f"{args.output_dir}/weights.parquet")
    for name, text in texts.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{args.output_dir}/{name}")


def main() -> None:
    spark = SparkSession.builder.appName("alpha-report").getOrCreate()
    run(spark, parse_args())


if __name__ == "__main__":
    main()
