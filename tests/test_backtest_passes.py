"""The backtest reads its cross-sections once, and its weights hold if values come out anew."""

import random

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quantloom.operators import xsection
from quantloom.plans import backtest


def test_weights_take_whole_tails_if_values_come_out_anew(spark):
    noisy = F.udf(lambda v: v + random.random() * 1e-9, DoubleType()).asNondeterministic()
    rows = spark.range(400).select((F.col("id") % 40).cast("string").alias("date"), noisy(F.floor(F.col("id") / 40).cast("double")).alias("x"))
    found = xsection.quantile_weights(rows, "x", ("date",)).groupBy("date").agg(F.sum("weight").alias("net"), F.sum(F.abs("weight")).alias("gross"), F.count(F.when(F.col("weight") != 0, 1)).alias("n")).collect()
    assert len(found) == 40 and {(r["n"], round(r["net"], 9), round(r["gross"], 9)) for r in found} == {(4, 0.0, 1.0)}


def test_measures_shuffle_the_cross_sections_once(spark):
    rows = spark.createDataFrame([("d", "alpha001", f"s{k}", float(k), float(k % 3), 0.0, 7, 7, 7) for k in range(7)], "date string, alpha string, symbol string, score double, forward double, weight double, n_rows long, n_scores long, n_returns long")
    plan = backtest.daily_measures(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(date") == 1
    assert "Join" not in plan
