import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quantloom.sources import ingest
from quantloom.sources.landed import landed_bars, share_files

SYMBOLS = [f"S{k}" for k in range(20)] + ["BRK.B", "a b"]


def land(folder, year: int, symbols, rows: int = 40):
    """A wide file with a hole, a symbol without volume and a column of no symbol."""
    value = lambda f, s, t: None if (s, t) == ("S1", 3) else 100.0 * ingest.PRICE_FIELDS.index(f) + len(s) + t + year / 1e4
    columns = {"date": [f"{year}-{1 + t // 28:02d}-{1 + t % 28:02d}" for t in range(rows)], "note": ["x"] * rows, "Open|LACKS": [1.0] * rows}
    columns |= {f"{f}|{s}": [value(f, s, t) for t in range(rows)] for s in symbols for f in ingest.PRICE_FIELDS}
    folder.mkdir(exist_ok=True)
    pq.write_table(pa.table(columns), f"{folder}/{year}.parquet", row_group_size=16)
    return {(d, s): tuple(columns[f"{f}|{s}"][t] for f in ingest.PRICE_FIELDS) for t, d in enumerate(columns["date"]) for s in symbols}


def rows_of(df):
    found = df.collect()
    got = {(str(r.date), r.symbol): tuple(r[f] for f in df.columns[2:]) for r in found}
    assert len(got) == len(found)
    return got


def test_all_bars_of_all_files(spark, tmp_path):
    want = land(tmp_path / "v", 2023, SYMBOLS) | land(tmp_path / "v", 2024, SYMBOLS[3:])
    df = landed_bars(spark, str(tmp_path / "v"), symbols="7")
    assert df.rdd.getNumPartitions() == 4 + 3
    assert rows_of(df) == want
    assert rows_of(landed_bars(spark, f"file://{tmp_path}/v/2024.parquet", date_type="date")) == {k: v for k, v in want.items() if k[0] > "2024"}
    one = landed_bars(spark, str(tmp_path / "v"), ["Close"])
    assert one.columns == ["date", "symbol", "Close"] and rows_of(one) == {k: v[3:4] for k, v in want.items()}
    wide = spark.read.parquet(f"{tmp_path}/v/2023.parquet")
    assert rows_of(ingest.unpivot_vendor(wide, [s for s in SYMBOLS if "." not in s])) == {k: v for k, v in want.items() if k[0] < "2024" and "." not in k[1]}
    with pytest.raises(Exception, match="no fields"):
        landed_bars(spark, str(tmp_path / "v"), ["Typo"]).collect()


def test_symbols_are_pushed_into_the_files(spark, tmp_path):
    want = land(tmp_path / "v", 2023, SYMBOLS)
    df = landed_bars(spark, str(tmp_path / "v"), symbols="2")
    for asked in (["S1"], ["S1", "BRK.B", "none"], SYMBOLS[:15], ["none"]):
        some = df.where(F.col("symbol").isin(asked) & (F.col("date") >= "2023-02-01"))
        assert rows_of(some) == {k: v for k, v in want.items() if k[1] in asked and k[0] >= "2023-02-01"}
        plan = spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted")
        assert "symbol" in plan.split("PushedFilters")[1].split("\n")[0] and not any("Condition" in line and "symbol" in line and "IN" in line for line in plan.split("\n")), plan
        assert some.rdd.getNumPartitions() == max(1, -(-len(set(asked) & set(SYMBOLS)) // 2))
    both = df.where("symbol in ('S1', 'S2') and symbol in ('S2', 'S3') and Close is not null")
    assert {s for _, s in rows_of(both)} == {"S2"}


def test_empty_folder_and_files_without_symbols(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert landed_bars(spark, str(tmp_path / "none")).count() == 0
    land(tmp_path / "bare", 2023, [])
    assert landed_bars(spark, str(tmp_path / "bare")).count() == 0


def test_share_files_by_symbol(spark, tmp_path):
    rows = spark.createDataFrame([("1", "2024-01-01", 5), ("2", "2024-01-01", 6), ("2", "2024-01-02", 7)], "symbol string, date string, shares long")
    rows.write.partitionBy("symbol").parquet(f"{tmp_path}/by")
    rows.write.parquet(f"{tmp_path}/flat")
    for at in ("by", "flat"):
        df = share_files(spark, f"{tmp_path}/{at}")
        assert sorted((r.symbol, r.date, r.shares) for r in df.collect()) == sorted(map(tuple, rows.collect()))
    plan = share_files(spark, f"{tmp_path}/by").where("symbol = '2'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in plan
