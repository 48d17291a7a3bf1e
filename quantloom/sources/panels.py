"""Date-by-symbol panels from order-line tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(lines: DataFrame) -> DataFrame:
    """Open, high, low, close, volume, vwap and market_cap of ``lines`` (symbol, date, price, quantity, amount); dates become text.

    A group's lines are sorted by value, so the median is read off its place and sums are added in one order, whichever task brings a
    line first: a plan that is computed twice, and two symbols with the same lines, have the same bars to the last digit.
    """
    group = W.partitionBy("symbol", "date")
    placed = lines.withColumns({"k": F.row_number().over(group.orderBy(F.col("price").asc_nulls_last(), "quantity", "amount")), "n": F.count("price").over(group)})
    middle = lambda at: F.max(F.when(F.col("k") == at, F.col("price"))) * 0.5
    close = middle(F.floor((F.col("n") + 1) / 2)) + middle(F.floor(F.col("n") / 2) + 1)
    bars = placed.groupBy("symbol", "date").agg(F.avg("price").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), close.alias("close"), F.sum("quantity").alias("volume"), F.try_divide(F.sum("amount"), F.sum("quantity")).alias("vwap"), F.sum("amount").alias("market_cap"))
    before = F.lag("close").over(W.partitionBy("symbol").orderBy("date"))
    return bars.withColumn("returns", F.try_divide("close", before) - 1.0).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


def _lines(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    date = F.to_date("l_shipdate") if unit == "day" else F.trunc(F.to_date("l_shipdate"), unit)
    return line.select("l_suppkey", date.alias("date"), F.try_divide("l_extendedprice", "l_quantity").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("amount"))


def supplier_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier is a symbol, a month of shipping a date; absent months have no row."""
    return _bars(_lines(spark, sf_dir, "month").withColumnRenamed("l_suppkey", "symbol"))


def supplier_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, sector (region), industry (nation), subindustry (nation and parity of the key)."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("symbol"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), F.concat("n_name", F.lit("-"), (F.col("s_suppkey") % 2).cast("string")).alias("subindustry"))


def _nations(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    names = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("symbol"))
    return _bars(_lines(spark, sf_dir, unit).join(names, "l_suppkey").drop("l_suppkey"))


def nation_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation of suppliers is a symbol, a week of shipping a date."""
    return _nations(spark, sf_dir, "week")


def nation_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation of suppliers is a symbol, a day of shipping a date."""
    return _nations(spark, sf_dir, "day")


def user_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (user), date (day), value (mean), n."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").alias("symbol"), F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
