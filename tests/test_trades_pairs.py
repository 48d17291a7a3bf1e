import random

import numpy as np
import pandas as pd
import pytest

from quantloom.plans.backtest import share_trades
from quantloom.plans.paper import pair_correlations


def plain_trades(weights, counted, prices):
    """A loop over an alpha's counted dates and the names that it ever holds."""
    out = {}
    for alpha, dates in counted.items():
        names = {s for (a, _, s) in weights if a == alpha}
        if not names:
            continue
        shares = dict.fromkeys(names, 0.0)
        for k, date in enumerate(dates, 1):
            bad, traded, dollars = False, 0.0, 0.0
            for s in names:
                w, price = weights.get((alpha, k, s), 0.0), prices.get((date, s))
                ok = price is not None and price > 0
                bad |= (w != 0 or shares[s] != 0) and not ok
                target = w / price if ok else shares[s]
                traded += abs(target - shares[s])
                dollars += abs(target - shares[s]) * price if ok else 0.0
                shares[s] = target
            out[alpha, k] = (None, None) if bad else (traded, dollars)
    return out


@pytest.mark.parametrize("seed,gaps", [(1, 0.0), (2, 0.3), (3, 0.7), (4, 0.95)])
def test_share_trades_equal_a_loop_over_dates(spark, seed, gaps):
    rng = random.Random(seed)
    days, names = list(range(30)), [f"s{i}" for i in range(6)]
    counted = {a: sorted(rng.sample(days, n)) for a, n in (("alpha001", 24), ("alpha002", 11), ("alpha003", 1), ("alpha004", 9))}
    weights = {(a, k, s): rng.choice([-0.5, 0.25, 1.0]) for a, d in counted.items() if a != "alpha004" for k in range(1, len(d) + 1) for s in names if rng.random() < 0.25}
    prices = {(d, s): rng.choice([None, 0.0, -1.0]) if rng.random() < 0.1 else rng.uniform(1, 9) for d in days for s in names if rng.random() >= gaps}
    held = spark.createDataFrame([(*k, w) for k, w in weights.items()], "alpha string, k int, symbol string, weight double")
    dates = spark.createDataFrame([(a, d, k) for a, ds in counted.items() for k, d in enumerate(ds, 1)], "alpha string, date int, k int")
    last = spark.createDataFrame([(a, len(ds)) for a, ds in counted.items()], "alpha string, last_k int")
    table = spark.createDataFrame([(d, s, p) for (d, s), p in prices.items()], "date int, symbol string, price double")
    found = share_trades(held, dates, last, table)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
    got = {(r.alpha, r.k): (r.shares_traded, r.dollar_volume) for r in found.collect()}
    want = plain_trades(weights, counted, prices)
    assert got.keys() == want.keys()
    for key, pair in want.items():
        assert all((a is None) == (b is None) and (a is None or a == pytest.approx(b)) for a, b in zip(got[key], pair)), (key, got[key], pair)


def test_pairs_with_missing_days_equal_pandas(spark):
    rng = random.Random(6)
    rows = [(d, f"alpha{a:03d}", None if rng.random() < 0.3 else rng.gauss(1e200 if a == 4 else 5, 1e199 if a == 4 else 1)) for d in range(40) for a in range(1, 7)]
    rows += [(d, "alpha007", 2.5) for d in range(40)] + [(1, "alpha008", 1.0), (2, "alpha008", 2.0)] + [(3, "alpha009", float("nan"))]
    df = spark.createDataFrame(rows, "date int, alpha string, pnl double").repartition(5)
    out = pair_correlations(df)
    assert "Window" not in out._jdf.queryExecution().toString()
    got = {(r.alpha_i, r.alpha_j): (r.observations, r.correlation) for r in out.collect()}
    wide = pd.DataFrame(rows, columns=["date", "alpha", "pnl"]).pivot(index="date", columns="alpha", values="pnl").astype(float)
    names = [f"alpha{a:03d}" for a in range(1, 7)]
    assert got.keys() == {(i, j) for i in names for j in names if j < i}
    for (i, j), (n, c) in got.items():
        both = wide[[i, j]].dropna() / wide[[i, j]].abs().max()
        assert n == len(both) and c == pytest.approx(np.corrcoef(both[i], both[j])[0, 1], abs=1e-9)
