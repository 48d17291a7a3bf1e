import random

import pytest
from pyspark.sql import functions as F

from quantloom.functions.weights import exp_weights
from quantloom.operators import carried_windows as cw
from quantloom.operators.carried_windows import Carried, carried_windows
from quantloom.operators.rolling import Rolling


@pytest.mark.parametrize("batch", [7, 10_000])
def test_carried_windows_equal_array_frames(spark, monkeypatch, batch):
    rng = random.Random(7)
    rows = [(s, t, rng.choice([None, float("nan")]) if rng.random() < 0.02 else rng.choice([0.1, 0.2, rng.gauss(0, 0.1)]), "c") for s in range(9) for t in range(rng.choice([1, 3, 40, 61]))]
    rows += [(None, t, 0.01 * (t % 7), "c") for t in range(30)]
    df = spark.createDataFrame(rows, "symbol int, t int, x double, __x0 string").repartition(4)
    ts, wanted, want = Rolling("symbol", "t"), {}, {}
    for w in (1, 2, 5, 16.5, 33):
        n = int(w)
        for kind, method in (("rank", ts.rank), ("argmax", ts.argmax), ("argmin", ts.argmin), ("decay", ts.decay_linear)):
            wanted[f"{kind}{n}"], want[f"{kind}{n}"] = Carried(kind, "x", w), method("x", w)
        weights = exp_weights(n, 3)
        wanted[f"product{n}"], want[f"product{n}"] = Carried("weighted_product", "x", n, weights), ts.weighted_product("x", weights)
    expected = {(r.symbol, r.t): r for r in df.withColumns(want).collect()}
    lagged = {(r.symbol, r.t): r.v for r in df.withColumn("l", ts.delay(F.when(~F.isnan("x"), F.col("x")), 4)).withColumn("v", ts.weighted_product("l", exp_weights(6, 3))).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = carried_windows(df, wanted | {"lagged": Carried("weighted_product", "x", 6, exp_weights(6, 3), 4)}, "symbol", "t")
        assert out.columns == [*df.columns, *wanted, "lagged"]
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for r in got:
        for name in wanted:
            a, b = r[name], expected[r.symbol, r.t][name]
            assert (a is None) == (b is None) and (a is None or a == pytest.approx(b, rel=1e-9, abs=1e-12)), (name, r.symbol, r.t, a, b)
        b = lagged[r.symbol, r.t]
        assert (r.lagged is None) == (b is None) and (b is None or r.lagged == pytest.approx(b, rel=1e-9, abs=1e-12))
    assert carried_windows(df.limit(0), wanted, "symbol", "t").count() == 0


def test_slices_are_bounded(monkeypatch):
    import numpy as np

    values, ends = np.random.default_rng(1).normal(size=500), np.arange(39, 500)
    whole = cw._reduce(values, ends, 40, "rank", None)
    monkeypatch.setattr(cw, "SLICE", 100)
    assert (cw._reduce(values, ends, 40, "rank", None) == whole).all()


def test_bad_windows_are_refused():
    for bad in (("median", "x", 3), ("weighted_product", "x", 3), ("rank", "x", 3, [1.0]), ("weighted_product", "x", 3, [1.0]), ("rank", "x", 3, None, -1)):
        with pytest.raises(ValueError):
            Carried(*bad)
