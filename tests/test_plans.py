import numpy as np
import pandas as pd
import pytest

from quantloom.plans import alphas, paper, riskmodel, styles
from quantloom.plans.backtest import analyze_alpha101, latest_alpha101_weights
from quantloom.plans.render import render_alpha101_paper_report, render_alpha101_report


def kernel(r, cap, sectors, styles_, residualize=True):
    """Weighted least squares written out with full matrices."""
    w = np.diag(np.sqrt(cap))
    k = sectors.shape[1]
    x = np.column_stack([np.ones(len(r)), sectors])
    change = np.vstack([np.eye(k), [0] + [-1] * (k - 1)])
    base = change @ np.linalg.lstsq(np.sqrt(w) @ x @ change, np.sqrt(w) @ r, rcond=None)[0]
    rest = r - x @ base
    f = np.linalg.lstsq(np.sqrt(w) @ styles_, np.sqrt(w) @ (rest if residualize else r), rcond=None)[0]
    return np.concatenate([base, f]), rest - styles_ @ f


@pytest.mark.parametrize("residualize", [True, False])
def test_factor_returns_match_full_matrices(spark, residualize):
    rng = np.random.default_rng(1)
    n, k, m = 60, 4, 2
    rows, want = [], {}
    for date in ("d1", "d2"):
        r, cap, z = rng.normal(size=n), rng.uniform(1, 9, n), rng.normal(size=(n, m))
        s = np.eye(k)[rng.integers(0, k - (date == "d2"), n)]  # on d2 a sector is empty
        want[date] = kernel(r, cap, s, z, residualize)
        rows += [(date, f"s{i:03d}", float(r[i]), float(cap[i]), *map(float, s[i]), *map(float, z[i])) for i in range(n)]
    names = [f"sec{i}" for i in range(k)], [f"sty{i}" for i in range(m)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["date", "symbol", "asset_returns", "market_cap", *names[0], *names[1]]))
    keys = ["date", "symbol"]
    wide, residuals = riskmodel.estimate_factor_returns(df, df, df.select(*keys, *names[0]), df.select(*keys, *names[1]), None, residualize)
    assert wide.columns == ["market", *names[0], *names[1], "date"]
    for row in wide.collect():
        got = np.array([row[c] for c in wide.columns[:-1]])
        assert np.allclose(got, want[row.date][0], atol=1e-8)
        assert abs(got[1 : 1 + k].sum()) < 1e-9
    eps = residuals.orderBy("date", "symbol").toPandas()
    for date in want:
        assert np.allclose(eps[eps.date == date].residual, want[date][1], atol=1e-8)


def test_factor_return_errors(spark):
    df = spark.createDataFrame([("d", "s", 1.0)], "date string, symbol string, asset_returns double")
    with pytest.raises(TypeError):
        riskmodel.estimate_factor_returns([], df, df, df)
    with pytest.raises(ValueError):
        riskmodel.estimate_factor_returns(df, df, df, df)


def test_momentum_warms_up(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(t, s, float(rng.normal(0, 0.01))) for t in range(12) for s in "abcdef"], "date int, symbol string, asset_returns double")
    got = styles.factor_mom(df, 4, 2, 3, 0.0).toPandas()
    assert got[got.mom_score.notna()].date.min() == 6
    assert abs(got[got.date == 11].mom_score.mean()) < 1e-9
    with pytest.raises(ValueError):
        styles.factor_mom(df.drop("symbol"))


def test_size_and_value(spark):
    df = spark.createDataFrame([(1, c, float(10**k), float(k + 1), float(k + 2), float(k)) for k, c in enumerate("abcde")], "date int, symbol string, market_cap double, book_price double, sales_price double, cf_price double")
    sze = {r.symbol: r.sze_score for r in styles.factor_sze(df).collect()}
    assert sze["a"] > 0 > sze["e"] and sze["c"] == 0
    val = {r.symbol: r.val_score for r in styles.factor_val(df).collect()}
    assert val["a"] < val["e"] and abs(sum(val.values())) < 1e-9


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(7)
    rows, price = [], np.full(5, 100.0)
    for t in range(40):
        before, price = price, price * np.exp(rng.normal(0, 0.02, 5))
        for s in range(5):
            c, o = price[s], price[s] * (1 + rng.normal(0, 0.01))
            h, l = max(o, c) * 1.01, min(o, c) * 0.99
            rows.append((t, f"S{s}", o, h, l, c, float(rng.integers(1e5, 1e6)), (h + l + c) / 3, c / before[s] - 1 if t else float("nan"), c * 1e6))
    return spark.createDataFrame(pd.DataFrame(rows, columns="date symbol open high low close volume vwap returns market_cap".split()))


def test_alphas_by_hand(spark, market):
    m = market.toPandas()
    got = alphas.factor_alpha101(market, None, [101, 12, 33, 101]).toPandas()
    assert list(got.columns) == ["date", "symbol", "alpha101", "alpha012", "alpha033"]
    m = m.sort_values(["date", "symbol"]).reset_index(drop=True)
    assert np.allclose(got.alpha101, (m.close - m.open) / (m.high - m.low + 0.001))
    assert np.allclose(got.alpha033, (m.open / m.close - 1).groupby(m.date).rank(pct=True))
    dv, dc = m.groupby("symbol").volume.diff(), m.groupby("symbol").close.diff()
    want = np.sign(dv) * -dc
    assert np.allclose(got.alpha012[want.notna()], want[want.notna()]) and got.alpha012[want.isna()].isna().all()


def test_ranks_in_one_pass_equal_ranks_by_windows(market):
    chosen = [2, 11, 17, 30, 34, 36]
    panel = alphas.dense_grid(market.select("date", "symbol", *[alphas.d.fin(c).alias(c) for c in alphas.FIELDS.values()]))
    wanted = {f"a{n}": alphas.build(n) for n in chosen}
    one, many = (alphas.evaluate(panel, wanted, ["date", "symbol"], most_sorts=k).toPandas().sort_values(["date", "symbol"]).reset_index(drop=True) for k in (3, 999))
    pd.testing.assert_frame_equal(one, many, atol=1e-9)


def test_lag_counts_market_dates(market):
    holes = market.where("not (symbol = 'S1' and date = 20)")
    got = alphas.factor_alpha101(holes, None, [12]).toPandas()
    own = got[got.symbol == "S1"].set_index("date").alpha012
    assert 20 not in own.index and np.isnan(own[21]) and not np.isnan(own[22])


def test_alpha_errors(spark, market):
    classes = spark.createDataFrame([(f"S{s}", "x") for s in range(5)], "symbol string, sector string")
    with pytest.raises(ValueError):
        alphas.factor_alpha101(market, None, [102])
    with pytest.raises(ValueError):
        alphas.factor_alpha101(market, classes, [48])
    with pytest.raises(ValueError):
        alphas.factor_alpha101(market.union(market), None, [101])
    with pytest.raises(TypeError):
        alphas.factor_alpha101([], None)
    with pytest.raises(ValueError):
        alphas.factor_alpha101(market, classes.where("symbol != 'S0'"), [58])
    assert alphas.factor_alpha101(market, None, []).columns == ["date", "symbol"]
    assert alphas.alpha_neutralization_levels()[67] == ("sector", "subindustry") and len(alphas.alpha_neutralization_levels()) == 18
    assert len({alphas.build(n).key for n in alphas.numbers()}) == 101


def scores_frame(spark, rows):
    return spark.createDataFrame(rows, "date int, symbol string, alpha001 double")


def loop_backtest(scores, returns, prices, q=0.2):
    """One alpha, date by date."""
    from tests.test_xsection import brute_weights

    dates, names = sorted({d for d, _ in scores}), sorted({s for _, s in scores})
    ahead = {}
    for s in names:
        own = sorted(d for d, x in returns if x == s)
        ahead |= {(a, s): returns[(b, s)] for a, b in zip(own, own[1:])}
    before, shares, out = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0), {}
    for d in dates:
        here = [s for s in names if (d, s) in scores and (d, s) in returns]
        values = [scores[(d, s)] for s in here]
        if sum(v is not None for v in values) < 5 or all(ahead.get((d, s)) is None for s, v in zip(here, values) if v is not None):
            continue
        w = dict.fromkeys(names, 0.0) | dict(zip(here, brute_weights(values, q)))
        pnl = sum(w[s] * (ahead.get((d, s)) or 0.0) for s in here)
        turn = 0.5 * sum(abs(w[s] - before[s]) for s in names)
        price = {s: prices.get((d, s)) if s in here else None for s in names}
        target = {s: w[s] / price[s] if price[s] else shares[s] for s in names}
        bad = any((w[s] or shares[s]) and not price[s] for s in names)
        moved = {s: abs(target[s] - shares[s]) for s in names}
        out[d] = (pnl, turn, None if bad else sum(moved.values()), None if bad else sum(moved[s] * price[s] for s in names if price[s]))
        before, shares = w, target
    return out


def test_backtest_matches_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    dates, names = range(25), [f"n{i:02d}" for i in range(9)]
    scores, returns, prices = {}, {}, {}
    for d in dates:
        for s in names:
            if rng.random() < 0.9:
                scores[(d, s)] = None if rng.random() < 0.35 else float(rng.integers(0, 6))
                returns[(d, s)] = float(rng.normal(0, 0.02))
                prices[(d, s)] = None if rng.random() < 0.05 else float(rng.uniform(5, 50))
    make = lambda t, c: spark.createDataFrame([(d, s, v) for (d, s), v in t.items()], f"date int, symbol string, {c} double")
    summary, daily = analyze_alpha101(make(scores, "alpha001"), make(returns, "asset_returns"), prices_df=make(prices, "close"))
    want = loop_backtest(scores, returns, prices)
    got = {r.date: (r.pnl, r.turnover, r.shares_traded, r.dollar_volume) for r in daily.collect()}
    assert got.keys() == want.keys()
    for d, values in want.items():
        assert got[d] == pytest.approx(values, abs=1e-9), d
    assert summary.collect()[0].days == len(want)


def test_backtest_needs_scores_and_columns(spark):
    df = scores_frame(spark, [(1, "a", 1.0)])
    returns = spark.createDataFrame([(1, "a", 0.1)], "date int, symbol string, asset_returns double")
    summary, daily = analyze_alpha101(df, returns)
    assert summary.count() == daily.count() == 0 and "sharpe" in summary.columns
    for bad in (0, 0.6):
        with pytest.raises(ValueError):
            analyze_alpha101(df, returns, bad)
    with pytest.raises(ValueError):
        analyze_alpha101(df.drop("alpha001"), returns)
    with pytest.raises(ValueError):
        analyze_alpha101(df, returns.drop("asset_returns"))
    with pytest.raises(TypeError):
        analyze_alpha101(df, [])


def test_latest_weights_have_every_symbol(spark):
    rows = [(1, f"s{i}", float(i)) for i in range(6)] + [(2, f"s{i}", float(i)) for i in range(3)] + [(1, "gone", None)]
    got = latest_alpha101_weights(scores_frame(spark, rows)).toPandas()
    assert set(got.date) == {1} and len(got) == 7
    assert got.weight.sum() == pytest.approx(0) and got[got.symbol == "s5"].weight.iloc[0] == 0.5


def test_correlation_survives_huge_values(spark):
    from quantloom.plans.backtest import _correlation

    df = spark.createDataFrame([(1, float(k) * 1e250, float(k)) for k in range(6)] + [(2, 1.0, float(k)) for k in range(6)], "g int, x double, y double")
    got = {r.g: r.c for r in _correlation(df, "x", "y", ("g",), "c").collect()}
    assert got[1] == pytest.approx(1) and got[2] is None


def test_paper_statistics(spark):
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=50), rng.normal(size=50)
    y = 1 + 2 * x - z + rng.normal(0, 0.1, 50)
    fit = {r.term: r for r in paper.ols(spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "z": z})), "y", ["x", "z"], "m").collect()}
    design = np.column_stack([np.ones(50), x, z])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    assert [fit[t].estimate for t in ("intercept", "x", "z")] == pytest.approx(beta.tolist())
    rss = ((y - design @ beta) ** 2).sum()
    assert fit["x"].r_squared == pytest.approx(1 - rss / ((y - y.mean()) ** 2).sum())
    assert fit["x"].standard_error == pytest.approx(np.sqrt(rss / 47 * np.linalg.inv(design.T @ design)[1, 1]))
    names = [f"alpha{k:03d}" for k in range(1, 5)]
    daily = spark.createDataFrame([(t, a, float(rng.normal(0.01, 0.02))) for t in range(40) for a in names], "date int, alpha string, pnl double")
    summary = spark.createDataFrame([(a, 0.1 + k * 0.1, 0.2 + 0.05 * k, 1.0, 0.3 + 0.1 * k * k, 2.0) for k, a in enumerate(names)], "alpha string, annual_return double, annual_volatility double, sharpe double, paper_turnover double, cents_per_share double")
    metrics, pairs, regressions = paper.analyze_alpha101_paper(summary, daily)
    assert metrics.count() == 4 and pairs.count() == 6
    assert {r.model for r in regressions.collect()} == {"log_return_on_log_volatility", "log_return_on_log_volatility_and_turnover", "correlation_on_turnover_tensors", "log_volatility_on_log_turnover"}
    text = render_alpha101_paper_report(metrics, pairs, regressions)
    assert "pairs: 6" in text
    with pytest.raises(ValueError):
        paper.analyze_alpha101_paper(summary.drop("sharpe"), daily)


def test_kde(spark):
    one = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [r.density for r in paper.gaussian_kde(one, "x").orderBy("x").collect()] == [0, 1, 0]
    assert paper.gaussian_kde(one.limit(0), "x").collect()[0].density == 0
    many = spark.createDataFrame([(float(k % 7),) for k in range(60)], "x double")
    got = paper.gaussian_kde(many, "x", 100).orderBy("x").toPandas()
    assert np.trapezoid(got.density, got.x) == pytest.approx(1, abs=0.01)


def test_report_text(spark):
    columns = "alpha string, days long, annual_return double, annual_volatility double, sharpe double, max_drawdown double, mean_ic double, mean_rank_ic double, mean_turnover double"
    df = spark.createDataFrame([("alpha001", 9, 0.1, 0.2, 0.5, -0.1, 0.01, 0.02, 0.3), ("alpha002", 9, 0.1, 0.2, None, -0.1, 0.01, 0.02, 0.3)], columns)
    text = render_alpha101_report(df)
    assert "alphas: 2" in text and "n/a" in text and "positive Sharpe: 1" in text
