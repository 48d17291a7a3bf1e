import argparse
import json

import pytest
from pyspark.sql import functions as F

from quantloom.report_job import metadata, parse_args, run
from quantloom.sources import ingest
from quantloom.streaming.cross_section import standardize_stream


def test_symbols_and_universe(spark):
    names = spark.createDataFrame([(" brk.b ", "B", "i1", "Specialty Stores"), ("BRK-B", "B", "i2", "Banks"), ("x", "X", "i1", "Banks")], "source_symbol string, security string, index string, subindustry string")
    levels = spark.createDataFrame([("S", "I", "Other Specialty Retail"), ("F", "G", "Banks")], "sector string, industry string, subindustry string")
    got = {r.symbol: r.sector for r in ingest.build_universe(names, levels).collect()}
    assert got == {"BRK-B": "S", "X": "F"}
    with pytest.raises(ValueError):
        ingest.build_universe(names, levels.limit(1))


def test_vendor_table_is_adjusted(spark):
    rows = [(f"2024-01-{d:02d}", *(v for f in (10.0, 12.0, 8.0, 11.0, 5.5, 100.0) for v in (f, f * 2)), None) for d in range(1, 31)]
    columns = ["date", *[f"{f}|{s}" for f in ingest.PRICE_FIELDS for s in ("A", "B")], "Open|C"]
    wide = spark.createDataFrame(rows, ", ".join(f"`{c}` {'string' if c == 'date' else 'double'}" for c in columns))
    bars = ingest.adjust_prices(ingest.unpivot_vendor(wide, ["A", "B", "C"]))
    row = bars.where("symbol = 'A'").first()
    assert (row.open, row.high, row.low, row.close, row.execution_price) == (5.0, 6.0, 4.0, 5.5, 11.0)
    assert row.vwap == pytest.approx(15.5 / 3) and bars.count() == 60
    assert ingest.adjust_prices(ingest.unpivot_vendor(wide.limit(29), ["A"])).count() == 0


def test_capitalization_is_point_in_time(spark):
    prices = spark.createDataFrame([("a", 1, 5.5, 11.0), ("a", 2, 6.0, 12.0), ("a", 3, 6.5, 13.0), ("b", 1, 1.0, 1.0)], "symbol string, date int, close double, execution_price double")
    shares = spark.createDataFrame([("a", 1, 100.0), ("a", 3, 120.0), ("a", 2, 0.0)], "symbol string, date int, shares double")
    got = {(r.symbol, r.date): r.market_cap for r in ingest.build_market_data(prices, shares).collect()}
    assert got == {("a", 1): 1100, ("a", 2): 1200, ("a", 3): 1560, ("b", 1): None}


def test_cache_is_made_anew_when_its_note_changes(spark, tmp_path):
    cache, made = ingest.TableCache(spark, str(tmp_path / "t")), []

    def make():
        made.append(1)
        return spark.range(len(made))

    for note, want in (({"v": 1}, 1), ({"v": 1}, 1), ({"v": 2}, 2)):
        assert cache.read_or_make(note, make).count() == want
    assert cache.read_or_make({"v": 2}, make, refresh=True).count() == 3
    assert ingest.fingerprint(["b", "a"], "x", "y") == ingest.fingerprint(["a", "b"], "x", "y")


def test_note_of_cached_scores_tells_other_inputs_apart(spark):
    market = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (1, "b", None)], "date int, symbol string, close double")
    universe = spark.createDataFrame([("a", "S"), ("b", "T")], "symbol string, sector string")
    note = ingest.score_note(market, universe, "1", "3")
    assert note == ingest.score_note(market.orderBy(F.desc("date")).repartition(3), universe.orderBy(F.desc("symbol")), "1", "3")
    revised = market.withColumn("close", F.when(F.col("date") == 2, 6.5).otherwise(F.col("close")))
    others = [(market, universe, "0", "3"), (market, universe, "1", "4"), (revised, universe, "1", "3"), (market, universe.withColumn("sector", F.lit("S")), "1", "3")]
    assert all(ingest.score_note(*other) != note for other in others)
    args = argparse.Namespace(end="3")
    found = metadata(market.withColumn("market_cap", F.col("close")), universe, market.where("date = 2"), args)
    assert found == {"constituents": 2, "histories": 2, "share_histories": 1, "scored": 1, "warmup_start": "1", "analysis_start": "2", "analysis_end": "2", "last_observation": "2", "end_exclusive": "3"}


def test_arguments():
    base = "--prices p --shares s --universe u --output-dir o --cache-dir c --warmup-start 2020-01-01 --start {} --end 2022-01-01".format
    assert parse_args(base("2021-01-01").split()).start == "2021-01-01"
    with pytest.raises(SystemExit):
        parse_args(base("2023-01-01").split())


def test_stream_is_standardized_by_date(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0), (2, "a", 5.0), (2, "b", 5.0)], "date int, symbol string, x double").write.parquet(src)
    stream = spark.readStream.schema("date int, symbol string, x double").parquet(src)
    standardize_stream(stream, "x", out, str(tmp_path / "ck")).awaitTermination()
    got = {(r.date, r.symbol): r.x for r in spark.read.parquet(out).collect()}
    assert got[(1, "a")] == pytest.approx(-(0.5**0.5)) and got[(2, "a")] is None


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "factor_sze" in entry.queries()
    assert json and run and F
