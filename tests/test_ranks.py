import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.operators.ranks import rank_columns, rank_groups
from quantloom.sources.scratch import Scratch


def frame(rng):
    rows = [("big", rng.choice([1.0, 2.0, 3.0]) if rng.random() < 0.5 else rng.gauss(0, 9), i) for i in range(3000)]
    rows += [(None, v, 4000 + i) for i, v in enumerate([0.0, -0.0, float("nan"), float("inf"), None, 5.0])]
    return rows + [("ties", 1.0, 5000 + i) for i in range(5)] + [("none", None, 6000)]


@pytest.mark.parametrize("rows_a_task,sent", [(10**6, 10**6), (100, 10**6), (100, 0)])
def test_ranks_of_groups_of_any_size(spark, rows_a_task, sent):
    rows = frame(random.Random(5))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "g string, x double, id int, part string").repartition(6)
    got = {r["id"]: r["rank"] for r in rank_groups(df, "x", ("g",), "rank", Scratch(spark, "r"), rows_a_task=rows_a_task, sent=sent).collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "id"]).replace(float("inf"), None)
    pdf["want"] = pdf.astype({"x": float}).groupby(pdf.g.fillna("~"))["x"].rank(pct=True)
    assert len(got) == len(rows)
    for id_, want in zip(pdf.id, pdf.want):
        assert (got[id_] is None) if want != want else got[id_] == pytest.approx(want, abs=1e-12), id_
    whole = rank_groups(df, "x", (), "x", Scratch(spark, "r"), share=False, rows_a_task=rows_a_task, sent=sent)
    assert whole.columns == ["g", "id", "part", "x"] and whole.agg(F.max("x")).first()[0] <= 3008
    assert rank_groups(df.limit(0), "x", ("g",), "rank", Scratch(spark, "r")).count() == 0


def test_many_columns_in_long_form(spark):
    rng = random.Random(2)
    rows = [(d, s, rng.choice([None, 1.0, 2.0, float("nan")]), rng.gauss(0, 1)) for d in range(12) for s in range(40)]
    df = spark.createDataFrame(rows, "date_idx int, symbol int, __x double, b double").repartition(3)
    arguments = {"r1": F.col("__x"), "r2": F.col("b"), "r3": F.col("__x") * F.col("b")}
    out = rank_columns(df, arguments, "date_idx", "symbol")
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    got = out.toPandas().sort_values(["date_idx", "symbol"]).reset_index(drop=True)
    pdf = pd.DataFrame(rows, columns=["date_idx", "symbol", "x", "b"]).astype({"x": float})
    pdf["xb"] = pdf.x * pdf.b
    for name, source in (("r1", "x"), ("r2", "b"), ("r3", "xb")):
        want = pdf.groupby("date_idx")[source].rank(pct=True)
        assert got[name].equals(want.rename(name)) or (got[name] - want).abs().max() < 1e-12 and (got[name].isna() == want.isna()).all()
