import random

import pytest
from pyspark.sql import functions as F

from quantloom.operators.long_windows import KINDS, Long, long_windows
from quantloom.operators.rolling import Rolling


def test_long_windows_equal_sliding_frames(spark):
    rng = random.Random(7)
    rows = [(s, t, None if rng.random() < 0.02 else rng.choice([1e8, rng.gauss(1e8, 1.0), float(rng.randrange(4))]), None if rng.random() < 0.02 else rng.gauss(5, 2), "c") for s in range(5) for t in range(90 if s else 3)] + [(9, t, 4.0, float(t), "c") for t in range(30)] + [(None, t, float(t % 7), 1.0, "c") for t in range(30)]
    df = spark.createDataFrame(rows, "symbol int, t int, x double, y double, __own string").repartition(4)
    ts, wanted, want = Rolling("symbol", "t"), {}, {}
    for w in (1, 2, 7, 20.9, 45):
        for kind in KINDS:
            name = f"{kind}_{int(w)}"
            pair = kind in ("covariance", "correlation")
            wanted[name] = Long(kind, "x", w, "y" if pair else None) if not (kind == "product") else Long(kind, "y", w)
            method = getattr(ts, "decay_linear" if kind == "decay" else kind)
            want[name] = method("x", "y", w) if pair else method("y" if kind == "product" else "x", w)
    expected = {(r.symbol, r.t): r for r in df.withColumns(want).collect()}
    out = long_windows(df, wanted, "symbol", "t")
    assert out.columns == [*df.columns, *wanted]
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        for name in wanted:
            a, b = r[name], expected[r.symbol, r.t][name]
            # sliding frames of huge values round more than the merged ones
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-7, abs=1e-4 if name.startswith("cov") else 1e-6)), (name, r.symbol, r.t, a, b)
    assert long_windows(df.limit(0), wanted, "symbol", "t").count() == 0


def test_a_column_may_be_replaced_and_bad_windows_are_refused(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(6)], "symbol int, t int, x double")
    out = long_windows(df, {"x": Long("sum", F.col("x") * 2, 3)}, "symbol", "t")
    assert out.columns == ["symbol", "t", "x"] and [r.x for r in out.orderBy("t").collect()] == [None, None, 6.0, 12.0, 18.0, 24.0]
    for bad in (("median", "x", 3, None), ("covariance", "x", 3, None), ("sum", "x", 3, "x")):
        with pytest.raises(ValueError):
            Long(*bad)


def test_one_shuffle_serves_all_lengths(spark):
    df = spark.range(1000).select((F.col("id") % 5).alias("symbol"), F.col("id").alias("t"), F.sqrt("id").alias("x"))
    plan = long_windows(df, {"a": Long("sum", "x", 100), "b": Long("std", "x", 250), "c": Long("max", "x", 60)}, "symbol", "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "collect_list" not in plan
