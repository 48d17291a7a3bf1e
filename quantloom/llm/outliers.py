"""Operator 12: quality rules with robust multivariate outliers, by language and source."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._graph import split_join
from ._runs import tidy
from ._stats import per_row, repeats, span_hashes
from ._store import Scratch
from ._text import column_bytes, mix64, pieces, word_spans

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_lines", "n_chars", "n_capitals", "n_digits")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPAN = 5  # words of a window
D, GRID, BINS, FINE = 8, 512, 400, 8
# spread that a coordinate has at least, in its own units: log words, log word length, angles of five shares, log richness
FLOOR = np.array([0.35, 0.10, 0.06, 0.15, 0.15, 0.06, 0.08, 0.06])
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def text_statistics(docs: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, ``part`` (a struct of the columns ``by`` as strings, null: empty) and COUNTS per row of ``docs``; a null text has no words.

    Words are ``[^\\x20\\x09-\\x0D]+`` and case counts.  n_repeat_words: words in windows of five words that stand twice or more
    in the text.  n_dup_lines: lines with a word that equal an earlier one; n_lines: lines with a word.
    """
    ship(docs.sparkSession)

    def count(column: pa.Array) -> list[np.ndarray]:
        data, offsets = column_bytes(column)
        n_rows = len(column)
        letter = (data & 0xC0) != 0x80
        starts, ends, words = word_spans(data, offsets)
        n = np.diff(words)
        row = np.repeat(np.arange(n_rows), n)
        hashes = span_hashes(data, starts, ends)
        distinct = np.bincount(row[~repeats(hashes, row)[0]], minlength=n_rows)
        # windows that don't cross a text's end
        first = np.flatnonzero(np.arange(len(row)) + _SPAN <= words[row + 1]) if len(row) else np.zeros(0, np.int64)
        runs = np.zeros(len(first), np.uint64)
        for k in range(_SPAN):
            runs = mix64(runs + hashes[first + k])
        twice = first[repeats(runs, row[first])[1]]
        cover = np.bincount(twice, minlength=len(row) + 1) - np.bincount(twice + _SPAN, minlength=len(row) + 1)[: len(row) + 1]
        repeated = np.bincount(row[np.cumsum(cover)[: len(row)] > 0], minlength=n_rows)
        # a line ends at a line feed or with its text
        feeds = np.flatnonzero(data == 10)
        line_starts = np.unique(np.concatenate([offsets[:-1], feeds + 1]))
        line_starts = line_starts[line_starts < len(data)]
        line_ends = np.append(line_starts[1:], len(data)).astype(np.int64)
        line_ends -= (line_ends > line_starts) & (data[line_ends - 1] == 10) if len(line_ends) else 0
        filled = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
        line_starts, line_ends = line_starts[filled], line_ends[filled]
        line_row = np.searchsorted(offsets, line_starts, "right") - 1
        again = repeats(span_hashes(data, line_starts, line_ends), line_row)[0]
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts] += 1
        inside[ends] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        return [n, per_row(letter & inside, offsets), per_row(_SYMBOL[data], offsets), np.bincount(line_row[again], minlength=n_rows), repeated, distinct, np.bincount(line_row, minlength=n_rows), per_row(letter, offsets), per_row((data >= 65) & (data <= 90), offsets), per_row((data >= 48) & (data <= 57), offsets)]

    def run(batches):
        for batch in batches:
            found = [count(batch["text"].slice(a, b - a)) for a, b in pieces(batch["text"])]
            counts = [np.concatenate(c).astype(np.int64) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], *map(pa.array, counts)], ["doc_id", "part", *COUNTS])

    part = F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"by{k}") for k, c in enumerate(by)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"by{k}: string" for k in range(len(by)))
    return rows.mapInArrow(tidy(run), f"doc_id long, part struct<{fields}>, " + ", ".join(f"{c} long" for c in COUNTS))


def vector() -> Column:
    """The statistics of a text as D whole numbers, in steps of 1 / GRID; whole numbers add up exactly in any order.

    Logs of lengths, angles of shares (which have about the same spread for rare and for common signs), and how many of the
    words are different, by Herdan's ratio of logs.  A share is of the text and a little more, since a few characters,
    words or lines say little.
    """
    c = F.col
    angle = lambda a, b, more: F.asin(F.sqrt(c(a) / (c(b) + more)))
    at = [F.log1p("n_words"), F.log((c("word_chars") + 1.0) / (c("n_words") + 1.0)), angle("n_symbols", "n_chars", 100), angle("n_dup_lines", "n_lines", 5), angle("n_repeat_words", "n_words", 20), angle("n_capitals", "n_chars", 100), angle("n_digits", "n_chars", 100), F.log(1.0 + c("n_distinct")) / F.log(2.0 + c("n_words"))]
    return F.array(*[F.floor(x * GRID + 0.5).cast("long") for x in at])


def chi2_below(x: float, d: int) -> float:
    """Share of a chi-square distribution with an even number ``d`` of degrees below ``x``."""
    return 1.0 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(d // 2)) if x < 1400 else 1.0


def chi2_at(p: float, d: int) -> float:
    low, high = 0.0, 1400.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, d) < p else (low, mid)
    return high


def _shape(centre: np.ndarray, spread: np.ndarray) -> dict:
    """A model row: centre, the inverse of ``spread`` as coefficients of PAIRS, log determinant."""
    inverse = np.linalg.inv(spread)
    return {"centre": centre.tolist(), "form": [float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS], "logdet": float(np.linalg.slogdet(spread)[1])}


def _from_sums(n: int, sums: np.ndarray, factor: float, few: float) -> dict:
    """The model of the rows that ``sums`` add up: their mean, and their covariance times ``factor``.

    FLOOR is added so that ties or statistics that are nearly always zero don't make everything else infinitely far; few
    rows don't know their spread, so ``few`` rows' worth of a wider one goes in.
    """
    mean = sums[:D] / n
    spread = np.zeros((D, D))
    for (i, j), s in zip(PAIRS, sums[D:]):
        spread[i, j] = spread[j, i] = s / n - mean[i] * mean[j]
    floor = (FLOOR * GRID) ** 2
    return _shape(mean, spread * factor + np.diag(floor * (1 + 8 * few / (n + few))))


_MODEL = "centre: array<double>, form: array<double>, logdet: double, n: long"


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n and sums (of z and of its products) of ``rows`` by ``keys``; added up before the shuffle."""
    z = [F.col("z")[k] for k in range(D)]
    sums = [F.sum(x) for x in z] + [F.sum(z[i] * z[j]) for i, j in PAIRS]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("sums"))


def distance(model: str) -> Column:
    """Squared Mahalanobis distance of ``z`` from the struct column ``model``."""
    off = [F.col("z")[k] - F.col(model)["centre"][k] for k in range(D)]
    total = F.lit(0.0)
    for k, (i, j) in enumerate(PAIRS):
        total = total + F.col(model)["form"][k] * off[i] * off[j]
    return F.greatest(total, F.lit(0.0))


def _bin(d2: Column) -> Column:
    return F.least(F.floor(FINE * F.log2(1.0 + d2)), F.lit(BINS)).cast("int")


class RobustModels:
    """Minimum-covariance-determinant estimates of every part.

    ``vectors`` is a written table (part, z).  Concentration steps go over it in Spark, all parts and starts at once: rows fall into
    fine bins of their distance, moments are added up by bin, and the bins up to the ``keep`` share of a part's rows give its
    next centre and covariance.  A step's shuffle has a row a part, start and bin, so no part, however large, is held by
    one task.  Starts are coordinate-wise medians with median deviations, and the plain covariance; the smaller
    determinant wins, then one step takes in all rows within the 0.975 quantile.

    Models are one row a part.  Up to ``most_sent`` parts (2 KB each) are broadcast; beyond that rows are joined on the part,
    frequent parts dealt out on several tasks.
    """

    def __init__(self, vectors: DataFrame, scratch: Scratch, keep: float = 0.75, steps: int = 12, few: float = 20.0, most_sent: int = 2000):
        self.vectors, self.scratch, self.keep, self.few, self.most_sent = vectors, scratch, keep, few, most_sent
        self.part_type = vectors.schema["part"].dataType.simpleString()
        self.parts = 0
        now = self._starts()
        before = None
        for k in range(steps):
            now = self._concentrate(now, f"step-{k}")
            mark = now.agg(F.sum(F.xxhash64("part", "models.n", F.transform("models.logdet", lambda x: F.round(x, 9))).cast("decimal(38,0)"))).first()[0]
            if mark == before:
                break
            before = mark
        least = F.array_min(F.transform("models", lambda m: m["logdet"]))
        best = now.select("part", F.slice(F.filter("models", lambda m: m["logdet"] == least), 1, 1).alias("models"))
        self.models = self._concentrate(self.scratch.write(best, "best"), "final", final=True)

    def _solve(self, gathered: DataFrame, solve, table: str) -> DataFrame:
        """One row a part: its gathered ``rows``, whose number is bounded by bins or grid, go through ``solve``, which gives models."""
        kind = pa.list_(pa.struct([("centre", pa.list_(pa.float64())), ("form", pa.list_(pa.float64())), ("logdet", pa.float64()), ("n", pa.int64())]))

        def run(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    part = batch.slice(k, 1)
                    yield pa.RecordBatch.from_arrays([part["part"], pa.array([solve(part["rows"].to_pylist()[0])], kind)], ["part", "models"])

        return self.scratch.write(gathered.mapInArrow(tidy(run), f"part {self.part_type}, models array<struct<{_MODEL}>>"), table)

    def _starts(self) -> DataFrame:
        # values on the grid: a part has a bounded number of them, however many its rows
        cells = self.vectors.select("part", F.posexplode("z").alias("k", "v")).groupBy("part", "k", "v").agg(F.count("*").alias("n"))
        plain = _moments(self.vectors, ["part"]).select("part", F.lit(-1).alias("k"), F.lit(0).cast("long").alias("v"), "n", "sums")
        both = cells.withColumn("sums", F.lit(None).cast("array<long>")).unionByName(plain)
        gathered = both.groupBy("part").agg(F.collect_list(F.struct("k", "v", "n", "sums")).alias("rows"))
        few = self.few

        def median(values: np.ndarray, n: np.ndarray) -> float:
            order = np.argsort(values, kind="stable")
            return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

        def solve(rows):
            whole = next(r for r in rows if r["k"] < 0)
            axes = [(np.array([r["v"] for r in rows if r["k"] == j], float), np.array([r["n"] for r in rows if r["k"] == j])) for j in range(D)]
            centre = np.array([median(v, n) for v, n in axes])
            wide = np.array([1.4826 * median(np.abs(v - c), n) for (v, n), c in zip(axes, centre)])
            robust, plain = _shape(centre, np.diag(wide**2 + (FLOOR * GRID) ** 2)), _from_sums(whole["n"], np.array(whole["sums"], float), 1.0, few)
            return [m | {"n": whole["n"]} for m in (robust, plain)]

        found = self._solve(gathered, solve, "starts")
        self.parts = found.count()
        return found

    def attach(self, rows: DataFrame, models: DataFrame) -> DataFrame:
        """``rows`` (a written table with part) with their part's models."""
        if self.parts <= self.most_sent:
            return rows.join(F.broadcast(models), "part", "left")
        return split_join(rows, models, "part", "left")

    def _concentrate(self, models: DataFrame, table: str, final: bool = False) -> DataFrame:
        near = self.attach(self.vectors, models).select("part", "z", F.posexplode("models").alias("start", "model"))
        binned = _moments(near.withColumn("at", _bin(distance("model"))), ["part", "start", "at"])
        gathered = binned.groupBy("part").agg(F.collect_list(F.struct("start", "at", "n", "sums")).alias("rows"))
        keep, few = self.keep, self.few

        def one(rows):
            at, n, sums = (np.array([r[c] for r in rows]) for c in ("at", "n", "sums"))
            total = np.cumsum(n)
            if final:
                inside = max(1, int(np.searchsorted(at, FINE * math.log2(1 + chi2_at(0.975, D)))))
                edge = 2.0 ** ((at[inside - 1] + 1) / FINE) - 1
            else:
                inside = int(np.searchsorted(total, keep * total[-1])) + 1
                edge = chi2_at(min(total[inside - 1] / total[-1], 0.9999), D)
            factor = min(chi2_below(edge, D) / max(chi2_below(edge, D + 2), 1e-9), 4.0)  # makes a cut-off normal's spread whole
            held = int(total[inside - 1])
            return _from_sums(held, sums[:inside].sum(0).astype(float), factor, few) | {"n": held}

        def solve(rows):
            starts = sorted({r["start"] for r in rows})
            return [one(sorted((r for r in rows if r["start"] == s), key=lambda r: r["at"])) for s in starts]

        return self._solve(gathered, solve, table)


def judge(docs: DataFrame, scratch: Scratch, by: tuple[str, ...] = ("lang", "source"), tail: float = 1e-9, least_words: int = 10, most_repeated: int = 20, **how) -> DataFrame:
    """Per row of ``docs`` (doc_id, text and the columns ``by``): doc_id, COUNTS, base_failed, distance and kept.

    base_failed: under ``least_words`` words, or over ``most_repeated`` per cent of them repeated.  Of the others those are kept
    whose squared distance from their part's robust centre is at most the 1 - ``tail`` quantile of chi-square with D degrees.
    Estimates are made from all documents, each different vector of a part once, so copies don't outvote the rest; a part
    of one vector has distance 0.  Nulls in ``by`` count as empty, an empty table has no rows, other columns are left out.
    """
    stats = scratch.write(text_statistics(docs, by).withColumn("z", vector()), "stats")
    vectors = scratch.write(stats.select("part", "z").distinct(), "vectors")
    robust = RobustModels(vectors, scratch, **how)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    placed = robust.attach(stats, robust.models).withColumn("model", F.col("models")[0])
    return placed.select("doc_id", "part", *COUNTS, failed.alias("base_failed"), distance("model").alias("distance")).withColumn("kept", ~F.col("base_failed") & (F.col("distance") <= chi2_at(1 - tail, D)))


def op12_mcd_rules(spark, sf_dir: str) -> DataFrame:
    """All ``documents``."""
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op12"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
