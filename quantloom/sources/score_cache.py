"""Scores kept between runs: only dates whose market rows have changed, with the history they need, are computed anew."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import fresh
from .scratch import Scratch


class ScoreCache:
    """A folder with ``scores/run=...`` (a run writes its own dates, nothing is rewritten) and ``notes-N`` (date, print, run).

    A date's print covers the market rows of the date and of ``history`` market dates before it, and ``basis``, a text that
    stands for all else (formula version, classes, chosen formulas).  The newest notes whose writing ended say which
    run holds a date; a run that was cut off is in no notes and is never read.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str = "") -> list[str]:
        at, fs = self._at(folder) if folder else self._at(".")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _finished(self) -> list[int]:
        found = [int(n[6:]) for n in self._names() if n.startswith("notes-")]
        return sorted(n for n in found if "_SUCCESS" in self._names(f"notes-{n}"))

    def notes(self) -> DataFrame | None:
        """date, print, run of what is kept; None in an empty cache."""
        done = self._finished()
        return self.spark.read.parquet(f"{self.path}/notes-{done[-1]}") if done else None

    def read(self, start=None, end=None) -> DataFrame:
        """The kept scores, from ``start`` to before ``end``."""
        notes = self.notes()
        if notes is None:
            raise ValueError("the cache is empty")
        held = notes.select(F.col("date"), F.col("run"))  # a row a market date
        scores = self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/scores").join(F.broadcast(held), ["date", "run"]).drop("run")
        scores = scores if start is None else scores.where(F.col("date") >= start)
        return scores if end is None else scores.where(F.col("date") < end)

    def prints(self, market: DataFrame, history: int, basis: str) -> DataFrame:
        """date, place among the market dates, print.  The last step is over one row a market date."""
        n, c = fresh("rows", market.columns), fresh("content", market.columns)
        days = market.groupBy("date").agg(F.count("*").alias(n), F.sum(F.xxhash64(*sorted(market.columns)).cast("decimal(38,0)")).alias(c))
        back = W.orderBy("date").rowsBetween(-history, 0)
        day = F.xxhash64("date", n, c).cast("decimal(38,0)")
        return days.select("date", (F.row_number().over(W.orderBy("date")) - 1).alias("place"), F.xxhash64(F.lit(basis), F.count("*").over(back), F.sum(day).over(back)).alias("print"))

    def refresh(self, market: DataFrame, score, history: int, basis: str, scratch: Scratch, start=None, anew: bool = False) -> DataFrame:
        """Bring the cache to ``market`` (date, symbol, ...; written, since it is read twice) and return its scores from ``start`` on.

        ``score`` makes date, symbol and scores of a market table; a score must hang on no more than ``history`` market dates
        before its own.  Stale dates that are no more than ``history`` apart are computed together.  Dates that the market no
        longer has leave the cache; dates before ``start`` are kept as they are, where their print still fits.
        """
        now = scratch.write(self.prints(market, history, basis), "prints")
        old = None if anew else self.notes()
        kept = None if old is None else now.join(old, ["date", "print"]).select("date", "print", "run")
        stale = now if start is None else now.where(F.col("date") >= start)
        stale = stale if kept is None else stale.join(kept, "date", "left_anti")
        todo = sorted(tuple(r) for r in stale.select("place", "date").collect())  # market dates
        if not todo and old is not None and kept.count() == old.count():
            return self.read(start)
        run = "r" + uuid.uuid4().hex
        groups: list[list] = []
        for place, date in todo:
            if groups and place - groups[-1][-1][0] <= history:
                groups[-1].append((place, date))
            else:
                groups.append([(place, date)])
        for group in groups:
            first, last = group[0][1], group[-1][1]
            dates = now.where(F.col("place").between(group[0][0] - history, group[-1][0])).select("date")
            rows = market.join(F.broadcast(dates), "date", "left_semi")
            made = score(rows).where(F.col("date").between(first, last)).join(F.broadcast(stale.select("date")), "date", "left_semi")
            made.write.mode("append").parquet(f"{self.path}/scores/run={run}")
        new = stale.select("date", "print", F.lit(run).alias("run"))
        number = max([int(n[6:]) for n in self._names() if n.startswith("notes-")], default=0) + 1
        (new if kept is None else kept.union(new)).coalesce(1).write.parquet(f"{self.path}/notes-{number}")
        return self.read(start)

    def vacuum(self) -> list[str]:
        """Delete runs that the newest notes don't name and all older notes; not while another job reads or refreshes the cache."""
        notes = self.notes()
        if notes is None:
            return []
        used = {f"run={r.run}" for r in notes.select("run").distinct().collect()}
        newest = self._finished()[-1]
        gone = [f"scores/{n}" for n in self._names("scores") if n.startswith("run=") and n not in used]
        gone += [n for n in self._names() if n.startswith("notes-") and n != f"notes-{newest}"]
        for name in gone:
            at, fs = self._at(name)
            fs.delete(at, True)
        return gone
