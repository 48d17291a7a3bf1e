import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators.histories import running
from quantloom.operators.joins import asof_backward, keep_last
from quantloom.plans.alphas import Alpha101
from quantloom.plans.paper import alpha_paths, largest, wide
from quantloom.sources.ingest import members
from quantloom.sources.scratch import Scratch


@pytest.mark.parametrize("sent", [10**5, 0])
def test_running_values_cross_slices(spark, sent):
    rng = random.Random(4)
    rows = [(rng.choice(["hot"] * 8 + ["b", None]), rng.randrange(60), i, rng.choice([None, rng.gauss(1, 0.2)]), "c") for i in range(1500)] + [("late", 59, 9000, None, "c")]
    df = spark.createDataFrame(rows, "s string, t int, id int, x double, __slice string").repartition(5)
    kinds = ["last", "sum", "product", "max", "min", "count"]
    out = running(df, {k: (k, "x") for k in kinds} | {"t": ("max", "t")}, "s", ("t", "id"), Scratch(spark, "h"), 7, sent)
    assert set(out.columns) == {*df.columns, *kinds}
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(rows)
    pdf = pd.DataFrame(rows, columns=["s", "t", "id", "x", "c"]).sort_values(["t", "id"])
    pdf["s"] = pdf.s.fillna("~")
    for _, own in pdf.groupby("s"):
        x = own.x.astype(float)
        known = x.notna().cumsum()
        want = {"last": x.ffill(), "sum": x.cumsum().ffill(), "product": x.cumprod().ffill(), "max": x.cummax().ffill(), "min": x.cummin().ffill(), "count": known}
        for k, values in want.items():
            for i, v in zip(own.id, values):
                assert (got[i][k] is None) if v != v else got[i][k] == pytest.approx(v), (k, i)
    assert running(df.limit(0), {"y": ("last", "x")}, "s", ("t", "id"), Scratch(spark, "h"), 3).count() == 0
    with pytest.raises(ValueError):
        running(df, {"y": ("median", "x")}, "s", ("t", "id"), Scratch(spark, "h"))


def test_asof_in_slices_and_by_arrival(spark):
    rng = random.Random(5)
    left = spark.createDataFrame([(rng.choice(["a", "b"]), rng.randrange(40), i, "c") for i in range(300)], "s string, t int, id int, __value string")
    right = spark.createDataFrame([(rng.choice(["a", "b"]), rng.randrange(40), rng.choice([None, rng.random()]), i) for i in range(60)], "s string, t int, v double, n int")
    plain = asof_backward(left, right, "s", "t", "v")
    assert plain.columns == [*left.columns, "v"]
    key = lambda df: sorted((r.id, r.v) for r in df.collect())
    fill = lambda df: [(i, -1.0 if v is None else v) for i, v in key(df.fillna(-1.0, ["v"]))]
    assert fill(plain) == fill(asof_backward(left, right, "s", "t", "v", scratch=Scratch(spark, "a")))
    twice = spark.createDataFrame([("a", 1, 9.0, 1), ("a", 1, 2.0, 2), ("a", 1, None, 3)], "s string, t int, v double, n int")
    one = spark.createDataFrame([("a", 5, 1)], "s string, t int, id int")
    assert asof_backward(one, twice, "s", "t", "v").first().v == 9.0 and asof_backward(one, twice, "s", "t", "v", "n").first().v == 2.0


def test_keep_last_members_wide_and_largest(spark):
    df = spark.createDataFrame([("a", 1, 9.0), ("a", 2, 1.0), ("a", 2, 3.0), (None, 5, None), ("b", None, 4.0)], "k string, n int, v double")
    assert sorted(map(str, keep_last(df, ("k",), "n").collect())) == sorted(map(str, [r for r in df.collect() if (r.k, r.n, r.v) in {("a", 2, 3.0), (None, 5, None), ("b", None, 4.0)}]))
    universe = spark.createDataFrame([("a", 1), ("a", 2), ("z", 3), (None, 4)], "k string, other int")
    assert members(df, universe, "k").count() == 3 and members(df, universe, "k").columns == df.columns
    table = wide(df, "n", "k", "v", ["a", "b", "q"])
    assert table.columns == ["n", "a", "b", "q"] and {(r.n, r.a, r.b, r.q) for r in table.collect()} == {(1, 9.0, None, None), (2, 3.0, None, None), (5, None, None, None), (None, None, 4.0, None)}
    with pytest.raises(ValueError):
        wide(df, "n", "k", "v", ["n"])
    assert [r.v for r in largest(df.withColumn("v", -F.col("v")), "v", 3).collect()] == [-9.0, -4.0, -3.0]
    daily = spark.createDataFrame([(1, "x", 0.5), (2, "x", -0.5), (3, "x", None), (1, "y", 0.0)], "date int, alpha string, pnl double")
    assert sorted((r.date, r.alpha, r.wealth, r.drawdown) for r in alpha_paths(daily).collect()) == [(1, "x", 1.5, 0.0), (1, "y", 1.0, 0.0), (2, "x", 0.75, -0.5)]


def test_single_formulas(spark):
    rng = random.Random(2)
    fields = ("open", "high", "low", "close", "volume", "vwap", "returns", "market_cap")
    market = spark.createDataFrame([(t, s, *[rng.uniform(1, 2) for _ in fields]) for t in range(6) for s in "abc"], "date int, symbol string, " + ", ".join(f"{f} double" for f in fields))
    single = Alpha101(market)
    rows = {(r.date, r.symbol): r for r in market.collect()}
    for r in single.alpha(101).collect():
        m = rows[r.date, r.symbol]
        assert r.alpha101 == pytest.approx((m.close - m.open) / (m.high - m.low + 0.001))
    for number in (0, 102, 48):  # 48 needs classes
        with pytest.raises(ValueError):
            single.alpha(number)
    with pytest.raises(ValueError):
        Alpha101(market.drop("vwap"))
