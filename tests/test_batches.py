"""The formulas in batches against the same formulas as windows of Spark."""

import math
import random

import pytest

from quantloom.operators.batches import PACK, Step, over_symbols
from quantloom.plans import alphas
from quantloom.sources.scratch import Scratch

CHOSEN = [9, 13, 26, 29, 30, 45, 54, 57, 81, 84, 100]


def market(spark, symbols=9, dates=70):
    rng, rows = random.Random(5), []
    for s in range(symbols):
        for t in range(dates):
            if rng.random() < 0.01:
                continue  # an absent row
            o, c = (rng.uniform(9, 11) for _ in range(2))
            v = None if rng.random() < 0.01 else float(rng.randrange(1, 9))
            rows.append((f"2024-{t:03d}", s, o, max(o, c) + 0.1, min(o, c) - 0.1, c, v, (o + c) / 2, float("nan") if rng.random() < 0.01 else rng.choice([0.0, rng.gauss(0, 0.1)]), 100.0 * s + t))
    df = spark.createDataFrame(rows, "date string, symbol int, open double, high double, low double, close double, volume double, vwap double, returns double, market_cap double")
    classes = spark.createDataFrame([(s, "ab"[s % 2], "cde"[s % 3], "fg"[s % 2]) for s in range(symbols)], "symbol int, sector string, industry string, subindustry string")
    return df, classes


def test_batches_equal_windows(spark):
    df, classes = market(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    try:
        got = alphas.factor_alpha101(df, classes, CHOSEN, Scratch(spark, "test-batches"))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        have = {(r.date, r.symbol): r for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # a shuffle a stage; before, each formula's ranks were rows of their own and each nested window a plan of its own
    assert plan.count("Repartition") <= 5 and "Window" not in plan and "Generate" not in plan and "Join" not in plan
    want = alphas.factor_alpha101(df, classes, CHOSEN).collect()
    assert len(have) == len(want) and got.columns == list(want[0].asDict())
    defined = 0
    for r in want:
        for name in got.columns[2:]:
            a, b = have[r.date, r.symbol][name], r[name]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-9)), (name, r.date, r.symbol, a, b)
            defined += a is not None
    assert defined > len(want) * len(CHOSEN) / 4


def test_formulas_of_one_kind(spark):
    df, classes = market(spark, 4, 12)
    for chosen in ([41], [33], [12], [41, 33]):
        got = alphas.factor_alpha101(df, classes, chosen, Scratch(spark, "test-batches")).collect()
        want = alphas.factor_alpha101(df, classes, chosen).collect()
        assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want] and want


def test_a_long_history_carries_only_what_windows_reach(spark):
    df = spark.createDataFrame([(s, t, float(t * t % 97)) for s in (1, None) for t in range(400)], "symbol int, date_idx int, x double")
    steps = [Step("s(x)", "sum", ("x",), (7,)), Step("t(s)", "tmax", ("s(x)",), (5,)), Step("l(t)", "lag", ("t(s)",), (3,))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        out = over_symbols(df, steps, [], ["l(t)"], ["symbol", "date_idx"], "symbol", "date_idx", 40).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x = [float(t * t % 97) for t in range(400)]
    sums = [sum(x[t - 6 : t + 1]) if t >= 6 else None for t in range(400)]
    assert len(out) == 800
    for r in out:
        t = r.date_idx - 3
        y = None if math.isnan(r[PACK][0]) else r[PACK][0]
        assert y == (max(sums[t - 4 : t + 1]) if t >= 10 else None)
