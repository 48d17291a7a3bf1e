import math

import pytest

from quantloom.operators.clean import fill_features, smooth_features
from quantloom.operators.joins import asof_backward, attach_classes, dense_grid
from quantloom.operators.rolling import Rolling, lookback

TS = Rolling("symbol", "date")


@pytest.fixture(scope="module")
def series(spark):
    values = [3.0, 1.0, 2.0, 2.0, None, 5.0, 4.0, 4.0, 6.0]
    return spark.createDataFrame([("s", t, v, float(t * t)) for t, v in enumerate(values)], "symbol string, date int, x double, y double")


def out(df, c):
    return [r[0] for r in df.select("date", c.alias("v")).orderBy("date").select("v").collect()]


def test_lookback():
    assert [lookback(w) for w in (0.3, 1, 4.99)] == [1, 1, 4]


def test_windows_need_all_values(series):
    assert out(series, TS.sum("x", 3)) == [None, None, 6, 5, None, None, None, 13, 14]
    assert out(series, TS.product("x", 2)) == [None, 3, 2, 4, None, None, 20, 16, 24]
    assert out(series, TS.min("x", 2)) == [None, 1, 1, 2, None, None, 4, 4, 4]
    assert out(series, TS.std("x", 1)) == [None] * 9


def test_rank_and_extremes(series):
    assert out(series, TS.rank("x", 3)) == [None, None, pytest.approx(2 / 3), pytest.approx(2.5 / 3), None, None, None, pytest.approx(0.5), 1.0]
    assert out(series, TS.argmax("x", 3)) == [None, None, 1, 2, None, None, None, 1, 3]
    assert out(series, TS.argmin("x", 3)) == [None, None, 2, 1, None, None, None, 2, 1]


def test_decay_puts_most_weight_on_the_newest(series):
    assert out(series, TS.decay_linear("x", 3))[2] == pytest.approx((3 + 2 * 1 + 3 * 2) / 6)


def test_correlation_is_zero_without_spread(spark):
    rows = [("s", t, 0.1, float(t)) for t in range(5)]
    df = spark.createDataFrame(rows, "symbol string, date int, x double, y double")
    assert out(df, TS.correlation("x", "y", 3)) == [None, None, 0, 0, 0]
    assert out(df, TS.correlation("y", "y", 3))[4] == pytest.approx(1)
    assert out(df, TS.covariance("y", "y", 3))[4] == pytest.approx(1)


def test_weighted_product(series):
    got = out(series, TS.weighted_product("x", [0.5, 1.0]))
    assert got[1] == pytest.approx((1 + 1.5) * (1 + 1.0) - 1)
    assert got[4] is None and got[5] is None


def test_shift_and_change(series):
    assert out(series, TS.delay("x", 2))[:4] == [None, None, 3, 1]
    assert out(series, TS.lead("x"))[:3] == [1, 2, 2]
    assert out(series, TS.change("x"))[1] == pytest.approx(-2 / 3)


def test_fill_and_smooth(spark):
    inf, nan = math.inf, math.nan
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, nan), ("a", 3, inf), ("a", 4, 4.0), ("b", 1, None), ("b", 2, 3.0)], "g string, d int, x double")
    filled = {(r.g, r.d): r.x for r in fill_features(df, ("x",), "d", "g").collect()}
    assert filled == {("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 4): 4, ("b", 1): None, ("b", 2): 3}
    smooth = {(r.g, r.d): r.x for r in smooth_features(df.where("d in (1, 4) or g = 'b'"), ("x",), "d", "g", 2).collect()}
    assert smooth == {("a", 1): None, ("a", 4): 2.5, ("b", 1): None, ("b", 2): None}
    with pytest.raises(ValueError):
        fill_features(df, ("z",), "d", "g")
    with pytest.raises(TypeError):
        smooth_features([], ("z",), "d", "g", 2)


def test_asof_takes_the_same_or_an_earlier_mark(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("a", 5), ("b", 2)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 30.0), ("a", 4, None), ("a", 2, 20.0), ("b", 3, 9.0)], "k string, t int, v double")
    got = {(r.k, r.t): r.v for r in asof_backward(left, right, "k", "t", "v").collect()}
    assert got == {("a", 1): None, ("a", 3): 30, ("a", 5): 30, ("b", 2): None}


def test_dense_grid_has_every_cell(spark):
    df = spark.createDataFrame([("a", 10, 1.0), ("b", 10, 2.0), ("a", 30, 3.0)], "symbol string, date int, x double")
    got = sorted((r.symbol, r.date, r.date_idx, r.x, r.present) for r in dense_grid(df).collect())
    assert got == [("a", 10, 0, 1, True), ("a", 30, 1, 3, True), ("b", 10, 0, 2, True), ("b", 30, 1, None, False)]
    assert dense_grid(df.limit(0)).count() == 0


def test_dated_classes(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "symbol string, date int")
    dated = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 9, "z")], "symbol string, date int, sector string")
    got = {(r.symbol, r.date): r.sector for r in attach_classes(df, dated, ["sector"]).collect()}
    assert got == {("a", 1): "x", ("a", 2): "y", ("b", 1): None}
