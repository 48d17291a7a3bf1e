import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.plans import alphas
from quantloom.report_job import parse_args, run
from quantloom.sources.score_cache import ScoreCache
from quantloom.sources.scratch import Scratch

CHOSEN = (4, 12, 23, 101)


def market_of(spark, dates: int, symbols: int = 6):
    """Bars with holes; the last symbol begins late, the first ends early."""
    rng = np.random.default_rng(3)
    rows = []
    for t in range(120):
        for s in range(symbols):
            close, spread, volume = 50 + 5 * rng.standard_normal(), rng.random(), 1e4 * (1 + rng.random())
            hole = rng.random() < 0.05 or (s == symbols - 1 and t < 80) or (s == 0 and t > 90)
            if t < dates and not hole:
                rows.append((f"2024-{1 + t // 28:02d}-{1 + t % 28:02d}", f"s{s}", close - spread / 2, close + spread, close - spread, close, volume, close + spread / 9, rng.standard_normal() / 50, close * 1e6))
    return spark.createDataFrame(rows, "date string, symbol string, open double, high double, low double, close double, volume double, vwap double, returns double, market_cap double")


def refresh(cache, market, spark, basis="1", **how):
    asked = []

    def score(rows):
        asked.append(rows.select("date").distinct().count())
        return alphas.factor_alpha101(rows, None, CHOSEN)

    before = cache.notes()
    known = set() if before is None else {r.run for r in before.select("run").distinct().collect()}
    got = cache.refresh(market, score, alphas.history(CHOSEN), basis, Scratch(spark, "c"), **how)
    new = sorted(r.date for r in cache.notes().collect() if r.run not in known)
    return got, new, asked


def same(got, want):
    a, b = ({(r.date, r.symbol): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys()
    for k in a:
        for n in CHOSEN:
            x, y = (r[k][f"alpha{n:03d}"] for r in (a, b))
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-9)), (k, n)


def test_only_changed_dates_are_computed(spark, tmp_path):
    cache, back = ScoreCache(spark, str(tmp_path / "c")), alphas.history(CHOSEN)
    assert 20 <= back < 30
    with pytest.raises(ValueError):
        cache.read()
    first, _, _ = refresh(cache, market_of(spark, 110), spark)
    days = [r.date for r in market_of(spark, 120).select("date").distinct().orderBy("date").collect()]
    full = market_of(spark, 120)
    got, new, asked = refresh(cache, full, spark)
    assert new == days[110:] and asked == [10 + back]
    want = alphas.factor_alpha101(full, None, CHOSEN)
    same(got, want)
    _, new, asked = refresh(cache, full.repartition(3), spark)
    assert new == [] and asked == []
    # a late correction: its date and those that can see it; the early one lies apart from the last
    revised = full.withColumn("close", F.when(F.col("date").isin(days[5], days[119]), F.col("close") + 0.125).otherwise(F.col("close")))
    got, new, asked = refresh(cache, revised, spark)
    assert new == [*days[5 : 6 + back], days[119]] and asked == [6 + back, 1 + back]
    same(got, alphas.factor_alpha101(revised, None, CHOSEN))
    # dates that are gone leave; another basis makes all stale; unused runs can be deleted
    got, new, _ = refresh(cache, revised.where(F.col("date") < days[118]), spark)
    assert new == [] and got.agg(F.max("date")).first()[0] == days[117]
    got, new, _ = refresh(cache, full, spark, basis="2", start=days[60])
    assert new == days[60:]
    same(got, want.where(F.col("date") >= days[60]))
    gone = cache.vacuum()
    assert gone and cache.vacuum() == [] and cache.read().count() == got.count()


def test_a_run_that_was_cut_off_is_not_read(spark, tmp_path):
    cache, full = ScoreCache(spark, str(tmp_path / "c")), market_of(spark, 50)
    refresh(cache, full.where("date < '2024-02-10'"), spark)

    def fails(rows):
        made = alphas.factor_alpha101(rows, None, CHOSEN)
        made.write.mode("append").parquet(str(tmp_path / "c/scores/run=rdead"))
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        cache.refresh(full, fails, alphas.history(CHOSEN), "1", Scratch(spark, "c"))
    got, _, _ = refresh(cache, full, spark)
    same(got, alphas.factor_alpha101(full, None, CHOSEN))
    empty, _, _ = refresh(ScoreCache(spark, str(tmp_path / "e")), full, spark)
    assert empty.count() == full.count() and "scores/run=rdead" in cache.vacuum()


def test_the_report_job_twice(spark, tmp_path):
    bars = market_of(spark, 112).withColumn("execution_price", F.col("close")).drop("returns", "market_cap").withColumn("date", F.to_date("date"))
    shares = spark.createDataFrame([(f"s{k}", 1000 * (k + 1)) for k in range(6)], "symbol string, shares long").withColumn("date", F.to_date(F.lit("2024-01-01")))
    bars.write.parquet(f"{tmp_path}/prices")
    shares.write.parquet(f"{tmp_path}/shares")
    spark.createDataFrame([(f"s{k}", "A", f"I{k % 2}", f"U{k % 3}") for k in range(1, 6)], "symbol string, sector string, industry string, subindustry string").coalesce(1).write.csv(f"{tmp_path}/universe", header=True)
    runs = []
    for end, out in (("2024-04-20", "o1"), ("2024-04-25", "o2")):
        args = parse_args(f"--prices {tmp_path}/prices --shares {tmp_path}/shares --universe {tmp_path}/universe --output-dir {tmp_path}/{out} --cache-dir {tmp_path}/cache --warmup-start 2024-01-01 --start 2024-03-01 --end {end} --alphas 4,12,101".split())
        run(spark, args)
        notes = ScoreCache(spark, f"{tmp_path}/cache/scores").notes().groupBy("run").agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b")).orderBy("a").collect()
        runs.append([(r.a, r.b) for r in notes])
    assert runs == [[("2024-03-01", "2024-04-19")], [("2024-03-01", "2024-04-19"), ("2024-04-20", "2024-04-24")]]
    for out in ("o1", "o2"):
        daily = spark.read.parquet(f"{tmp_path}/{out}/daily.parquet").select("alpha").distinct().collect()
        assert {r.alpha for r in daily} == {r.alpha for r in spark.read.csv(f"{tmp_path}/{out}/summary.csv", header=True).collect()} and len(daily) >= 2
        weights = spark.read.parquet(f"{tmp_path}/{out}/weights.parquet")
        assert "s0" not in {r.symbol for r in weights.collect()}  # not in the universe
        assert all(glob.glob(f"{tmp_path}/{out}/{name}/part-*") for name in ("alpha_analysis.md", "alpha_statistics.md", "metadata.json", "metrics.csv", "pairs.csv", "regressions.csv"))
        assert spark.read.parquet(f"{tmp_path}/{out}/paths.parquet").count()
