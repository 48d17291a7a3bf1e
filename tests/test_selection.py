import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import xsection as xs
from quantloom.operators.dealt import attach_rows, frequent_keys
from quantloom.operators.selection import order_key, select_ranks
from quantloom.sources.scratch import Scratch

SPECIAL = [0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 1e308, -1e308, 1.7976931348623157e308, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-310, 4.0, 3.9999999999999996, 1.0000000000000002, 0.9999999999999999, float("inf"), float("-inf")]


def test_keys_order_as_doubles(spark):
    rng = random.Random(3)
    values = SPECIAL + [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(4000)] + [2.0**k for k in range(-1074, 1024)]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", order_key(F.col("x")).alias("k")).collect()
    for row in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(row.x)))[0]
        assert row.k == (-bits if row.x < 0 else bits), row.x
    nan, null = (spark.createDataFrame([(v,)], "x double").select(order_key(F.col("x"))).first()[0] for v in (float("nan"), None))
    assert nan > max(r.k for r in got) and null is None


@pytest.mark.parametrize("sent", [1000, 0])
def test_ranks_of_groups(spark, sent):
    rng = random.Random(8)
    data = [("big", rng.choice([1.0, 2.0, 1e-300, -1e300]) if rng.random() < 0.3 else rng.gauss(0, 1e3)) for _ in range(4000)]
    data += [(None, v) for v in SPECIAL] + [("ties", 7.0)] * 30 + [("none", None)] * 3 + [("one", -3.0), ("near", 1.0), ("near", 1.0000000000000002), ("near", None)]
    df = spark.createDataFrame([(g, v, i, "clash") for i, (g, v) in enumerate(data)], "g string, x double, n int, lo string").repartition(5)
    places = {"first": lambda n: n * 0, "low": lambda n: F.floor(n * 0.1), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}
    found = select_ranks(df, ("g",), {"x": F.col("x"), "y": -F.col("x")}, places, Scratch(spark, "sel"), sent)
    rows = {r["g"]: r for r in found.collect()}
    assert set(rows) == {"big", None, "ties", "none", "one", "near"}
    for g, row in rows.items():
        for sign, name in ((1, "x"), (-1, "y")):
            own = np.sort([sign * v for k, v in data if k == g and v is not None])
            assert row[f"{name}_n"] == len(own)
            for p, at in (("first", 0), ("low", int(len(own) * 0.1)), ("mid", len(own) // 2), ("last", len(own) - 1)):
                got = row[f"{name}_{p}"]
                if not len(own):
                    assert got is None
                else:
                    assert (got.value, got.below, got.equal) == (own[at], (own < own[at]).sum(), (own == own[at]).sum())


def test_selection_forms_equal_the_array_forms(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), None if rng.random() < 0.1 else rng.choice([float("nan"), float("inf"), 3.0, rng.gauss(0, 5), rng.gauss(0, 5)]), i, "x") for i in range(600)] + [("const", 2.0, 900 + i, "x") for i in range(4)] + [("empty", None, 990, "x")]
    df = spark.createDataFrame(rows, "g string, x double, id int, __b string").repartition(3)
    scratch = lambda: Scratch(spark, "t")

    def same(a, b, what):
        a, b = ({r["id"]: r[what] for r in d.collect()} for d in (a, b))
        assert a.keys() == b.keys() == {r[2] for r in rows}
        assert all((a[k] is None and b[k] is None) or a[k] == pytest.approx(b[k], rel=1e-12, nan_ok=True) for k in a)

    for share in (0.0, 0.05, 0.5, 0.7, 1.0):
        same(xs.winsorize_xsection(df, ["x"], "g", share), xs.winsorize_xsection(df, ["x"], "g", share, scratch()), "x")
    for pair in ((0.25, 0.75), (0.0, 1.0), (0.5, 0.5)):
        same(xs.mask_middle(df, "x", "g", *pair, -1.0), xs.mask_middle(df, "x", "g", *pair, -1.0, scratch()), "x")
    for share in (0.01, 0.2, 0.5):
        same(xs.quantile_weights(df, "x", ("g",), share), xs.quantile_weights(df, "x", ("g",), share, scratch=scratch()), "weight")
    empty = df.limit(0)
    assert xs.winsorize_xsection(empty, ["x"], "g", 0.1, scratch()).count() == xs.quantile_weights(empty, "x", ("g",), scratch=scratch()).count() == 0
    assert xs.winsorize_xsection(df, ["x"], "g", 0.1, scratch()).columns == df.columns


def test_plans_gather_no_group(spark):
    df = spark.range(2000).select(F.lit(1).alias("g"), F.sqrt("id").alias("x"))
    plan = xs.quantile_weights(df, "x", ("g",), scratch=Scratch(spark, "t"))._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan and "Window" not in plan


def test_rows_of_frequent_keys_are_dealt_out(spark):
    df = spark.createDataFrame([("hot", i) for i in range(3000)] + [(None, i) for i in range(900)] + [(f"k{i}", i) for i in range(500)], "k string, v int").repartition(4)
    small = spark.createDataFrame([("hot", 1), (None, 2), ("k7", 3), ("other", 4)], "k string, w int")
    assert len(frequent_keys(df, ["k"])) == 2
    want = sorted(str((r.k, r.v, {"hot": 1, None: 2, "k7": 3}.get(r.k))) for r in df.collect())
    for sent in (100, 0):
        got = attach_rows(df, small, ["k"], sent=sent)
        assert got.columns == ["k", "v", "w"] and sorted(str(tuple(r)) for r in got.collect()) == want
