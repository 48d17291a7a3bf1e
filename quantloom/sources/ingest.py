"""Transforms of landed market files, and the caches and sinks of a report job."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.joins import asof_backward
from ..operators.rolling import Rolling

# fixed values: names that the vendor's hierarchy spells differently
SUBINDUSTRY_ALIASES = {"Specialty Stores": "Other Specialty Retail"}
PRICE_FIELDS = ["Open", "High", "Low", "Close", "Adj Close", "Volume"]
FORMULA_VERSION = "1"


def normalize_symbol(symbol: Column | str) -> Column:
    """Trimmed, upper case, share classes after a dash."""
    return F.replace(F.upper(F.trim(F.col(symbol) if isinstance(symbol, str) else symbol)), F.lit("."), F.lit("-"))


def members(df: DataFrame, universe: DataFrame, symbol: str = "symbol") -> DataFrame:
    """The rows of ``df`` whose symbol is in ``universe``, however often; a NULL symbol is in none.  A semi-join, so no row is repeated."""
    return df.join(universe.select(symbol).distinct(), symbol, "left_semi").select(*df.columns)


def build_universe(constituents: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Constituents (source_symbol, security, index, subindustry) with sector and industry of ``hierarchy``.

    One row per symbol (the first by source symbol and index); a name without a place in the hierarchy is an error.
    """
    name = F.col("subindustry")
    for old, new in SUBINDUSTRY_ALIASES.items():
        name = F.when(name == old, new).otherwise(name)
    levels = hierarchy.select("sector", "industry", "subindustry").dropDuplicates(["subindustry"])
    joined = constituents.withColumn("subindustry", name).join(levels, "subindustry", "left").withColumn("symbol", normalize_symbol("source_symbol"))
    first = F.row_number().over(W.partitionBy("symbol").orderBy("source_symbol", "index"))
    universe = joined.withColumn("__n", first).where("__n = 1").select("symbol", "source_symbol", "security", "index", "sector", "industry", "subindustry")
    if universe.where("sector is null or industry is null or subindustry is null").limit(1).count():
        raise ValueError("the hierarchy doesn't cover all constituents")
    return universe


def unpivot_vendor(wide: DataFrame, symbols: list[str], date: str = "date") -> DataFrame:
    """Rows of date, symbol and the vendor's fields from columns named ``Field|SYMBOL``; symbols that lack a field are left out."""
    have = [s for s in symbols if all(f"{f}|{s}" in wide.columns for f in PRICE_FIELDS)]
    if not have:
        return wide.sparkSession.createDataFrame([], "date string, symbol string, " + ", ".join(f"`{f}` double" for f in PRICE_FIELDS))
    rows = F.array(*[F.struct(F.lit(s).alias("symbol"), *[F.col(f"`{f}|{s}`").cast("double").alias(f) for f in PRICE_FIELDS]) for s in have])
    return wide.select(F.col(date).alias("date"), F.explode(rows).alias("r")).select("date", "r.*")


def adjust_prices(bars: DataFrame, least_rows: int = 30) -> DataFrame:
    """Adjusted open, high, low, close, with execution_price, volume and typical price, for symbols of at least
    ``least_rows`` adjusted closes; rows without one are dropped."""
    enough = F.count("Adj Close").over(W.partitionBy("symbol"))
    ratio = F.try_divide("Adj Close", "Close")
    kept = bars.withColumn("__n", enough).where((F.col("__n") >= least_rows) & F.col("Adj Close").isNotNull())
    out = kept.select(F.to_date("date").alias("date"), "symbol", *[(F.col(c) * ratio).alias(c.lower()) for c in ("Open", "High", "Low")], F.col("Adj Close").alias("close"), F.col("Close").alias("execution_price"), F.col("Volume").alias("volume"))
    return out.withColumn("vwap", (F.col("high") + F.col("low") + F.col("close")) / 3.0)


def build_market_data(prices: DataFrame, shares: DataFrame) -> DataFrame:
    """Prices with ``market_cap`` (execution price times the latest known shares) and ``returns`` of the adjusted close."""
    known = shares.where(F.col("shares") > 0).select("symbol", "date", F.col("shares").cast("double").alias("shares"))
    joined = asof_backward(prices, known, "symbol", "date", "shares")
    return joined.withColumns({"market_cap": F.col("execution_price") * F.col("shares"), "returns": Rolling().change("close")}).drop("shares")


def fingerprint(symbols: list[str], start: str, end: str) -> dict[str, str]:
    """What a cached price table was made from."""
    return {"start": start, "end": end, "universe": hashlib.sha256("\n".join(sorted(symbols)).encode()).hexdigest()}


class TableCache:
    """A Parquet table with a JSON note of what it was made from; another note makes it stale."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def note(self) -> dict | None:
        try:
            rows = self.spark.read.text(f"{self.path}.note", wholetext=True).collect()
            found = json.loads("".join(r[0] for r in rows))
        except Exception as e:  # absent or no JSON
            if isinstance(e, (KeyboardInterrupt, MemoryError)):
                raise
            return None
        return found if isinstance(found, dict) else None

    def read_or_make(self, note: dict, make, refresh: bool = False) -> DataFrame:
        if refresh or self.note() != note:
            make().write.mode("overwrite").parquet(self.path)
            self.spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}.note")
        return self.spark.read.parquet(self.path)


def checksum(df: DataFrame) -> str:
    """Of all rows and columns; their order doesn't matter."""
    return str(df.agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first()[0])


def score_note(market: DataFrame, universe: DataFrame, start: str, end: str) -> dict:
    """What makes cached scores current: formula version, asked dates, extent and content of the market table and of the universe."""
    r = market.agg(F.min("date").cast("string").alias("a"), F.max("date").cast("string").alias("b"), F.count_distinct("symbol").alias("n")).first()
    return {"version": FORMULA_VERSION, "start": start, "end": end, "first": r["a"], "last": r["b"], "symbols": r["n"], "market": checksum(market), "universe": checksum(universe)}
