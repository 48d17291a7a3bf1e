"""A few queries against their SQL on the smallest tables; the driver compares all of them."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["panel_dense", "winsorize", "percentiles", "factor_sze", "ts_rank", "alpha_044", "alphas_021_028", "pairs_corr", "bt_turnover", "bt_shares", "winsorize_lines", "percentiles_lines", "rank_lines", "running_one", "asof_one", "keep_last", "largest_weights", "alphas_013_085", "scores_in_two_runs", "landed_bars"])
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    want = sorted(repr([row[k] for k in at]) for row in cursor.fetchall())
    assert want and sorted(repr([row[c] for c in columns]) for row in df.collect()) == want
