"""Operator 11: how filters interact, over every order in which they could be applied."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shipping import ship
from ._runs import tidy
from ._stats import per_row, repeats, span_hashes
from ._text import column_bytes, pieces, word_spans

MOST_FILTERS, PARTS_AT_ONCE = 8, 32
_SIGN = np.zeros(256, bool)
_SIGN[list(b"#$%&*|")] = True


def plain_changes(k: int):
    """Places i of the swaps (i, i + 1) that lead from the first order of ``k`` things through all others, each once."""
    if k < 2:
        return
    down = True
    for inner in chain(plain_changes(k - 1), [None]):
        yield from range(k - 2, -1, -1) if down else range(k - 1)  # the last thing moves through the others
        if inner is not None:
            yield inner + down  # then they move by one swap; it stands in front of them or behind
        down = not down


class Walk:
    """Counts of every step of an order of filters, kept up to date from swap to swap.

    ``cells`` are (3, parts, 2**k) counts: of documents, of good and of toxic ones, by the set of filters they fail.  What is
    left after a step hangs on the set of filters up to it, so swapping steps i and i + 1 changes what is left after
    step i alone, and what these two remove; only that is counted anew from the cells.
    """

    def __init__(self, cells: np.ndarray, k: int):
        self.cells, self.k, self.order = cells, k, list(range(k))
        self.masks = np.arange(1 << k)
        self.left = np.empty((k + 1, *cells.shape[:2]), np.int64)  # before the first step, after each
        self.left[0] = cells.sum(2)
        self.lost = np.empty((k, *cells.shape[:2]), np.int64)
        self.fails = np.stack([cells[0][:, self.masks >> f & 1 == 1].sum(1) for f in range(k)])
        self.only = np.stack([cells[0][:, 1 << f] for f in range(k)])
        self.shapley = np.zeros((k, cells.shape[1]), np.int64)
        for i in range(k):
            self._count(i)
        for i in range(k):
            self._step(i)
        self._add()

    def _count(self, i: int) -> None:
        before = sum(1 << f for f in self.order[: i + 1])
        self.left[i + 1] = self.cells[:, :, self.masks & before == 0].sum(2)

    def _step(self, i: int) -> None:
        self.lost[i] = self.left[i] - self.left[i + 1]

    def _add(self) -> None:
        self.shapley[self.order] += self.lost[:, 0]

    def swap(self, i: int) -> None:
        self.order[i], self.order[i + 1] = self.order[i + 1], self.order[i]
        self._count(i)
        self._step(i)
        self._step(i + 1)
        self._add()

    def rows(self) -> np.ndarray:
        """(parts, k, 6): kept, removed, redundant, unique_fails, good_lost, toxic_lost of the order as it stands."""
        fails, only = self.fails[self.order], self.only[self.order]
        return np.stack([self.left[1:, 0], self.lost[:, 0], fails - self.lost[:, 0], only, self.lost[:, 1], self.lost[:, 2]], 2).transpose(1, 0, 2)


def audit(cells: DataFrame, filters: str) -> DataFrame:
    """Per part, order of ``filters`` (a letter each, at most 8) and step, what that step does.

    ``cells`` has part, mask (bit f: fails filter f), n, good, toxic: counts, one row a part and mask.  Returns part, filter_order,
    step (from 1), kept, removed, redundant (fail its filter but are gone), unique_fails (fail it alone), good_lost,
    toxic_lost and shapley (its removed summed over all orders).  Zeros are kept; no cells give no rows.
    """
    k = len(filters)
    if not 1 <= k <= MOST_FILTERS or len(set(filters)) < k:
        raise ValueError(f"between 1 and {MOST_FILTERS} different filters are needed")
    ship(cells.sparkSession)
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in [*counts, "shapley"])

    def walk(parts: pa.Array, table: np.ndarray):
        at = Walk(table, k)
        found, orders = [at.rows()], [list(at.order)]
        for i in plain_changes(k):
            at.swap(i)
            found.append(at.rows())
            orders.append(list(at.order))
        rows = np.stack(found, 1).reshape(-1, 6)
        shapley = at.shapley[np.array(orders)].transpose(2, 0, 1).reshape(-1)
        names = ["".join(filters[f] for f in o) for o in orders]
        each, n = len(orders) * k, len(parts)
        columns = [parts.take(pa.array(np.repeat(np.arange(n), each))), pa.array(np.repeat(names, k).tolist() * n), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(orders) * n))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(rows[:, c])) for c in range(6)), pa.array(shapley)], ["part", "filter_order", "step", *counts, "shapley"])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, PARTS_AT_ONCE):
                some = batch.slice(a, PARTS_AT_ONCE)
                table = np.zeros((3, some.num_rows, 1 << k), np.int64)
                for p, row in enumerate(some["cells"].to_pylist()):
                    for c in row:
                        table[:, p, c["mask"]] = c["n"], c["good"], c["toxic"]
                yield walk(some["part"], table)

    # at most 2**k rows a part
    gathered = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return gathered.mapInArrow(tidy(run), schema)


def text_failures(docs: DataFrame, by: str = "source") -> DataFrame:
    """doc_id, part (the value of ``by``, null: empty), digest of the text, and mask: bits 0 to 3 for the text rules A to D.

    A: under 50 words. B: 100 * distinct words < 65 * words. C: 100 * capitals A-Z > 5 * code points. D: one of ``#$%&*|``.
    Words ``[^\\x20\\x09-\\x0D]+``, with regard to case; a null text is empty.
    """
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            masks = []
            for a, b in pieces(batch["text"]):
                data, offsets = column_bytes(batch["text"].slice(a, b - a))
                starts, ends, words = word_spans(data, offsets)
                n = np.diff(words)
                row = np.repeat(np.arange(b - a), n)
                distinct = np.bincount(row[~repeats(span_hashes(data, starts, ends), row)[0]], minlength=b - a)
                capitals, chars = per_row((data >= 65) & (data <= 90), offsets), per_row((data & 0xC0) != 0x80, offsets)
                fails = [n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * chars, per_row(_SIGN[data], offsets) > 0]
                masks.append(sum(f.astype(np.int32) << k for k, f in enumerate(fails)))
            digests = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").digest() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], pa.array(digests, pa.binary()), pa.array(np.concatenate(masks) if masks else [], pa.int32())], ["doc_id", "part", "digest", "mask"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(by).cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), "doc_id long, part string, digest binary, mask int")


def count_cells(failures: DataFrame, labels: DataFrame, copy_bit: int = 4) -> DataFrame:
    """part, mask, n, good, toxic from text_failures(), with bit ``copy_bit`` for a text that a smaller doc_id has too.

    A document is good or toxic where any row of ``labels`` with its id says 1.  Rows are counted as often as they
    stand; a row with the same id and text isn't smaller, and one without an id neither is nor has a smaller one.

    No join on texts: rows are added up by text, part, rules and labels before a shuffle, each sum with its least id
    and how many rows have it; so copies, however many, are few rows when the least id of a text is looked up.
    """
    once = failures.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("times"))  # repeated rows
    # ids that are null meet no label: by their digest they don't all go to one task
    once = once.withColumn("spread", F.when(F.col("doc_id").isNull(), F.col("digest")))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*[F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))])
    said = said.withColumn("spread", F.lit(None).cast("binary"))
    met = (once["doc_id"] == said["doc_id"]) & once["spread"].eqNullSafe(said["spread"])
    rows = once.join(said, met, "left").select(once["*"], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    sums = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("times").alias("n"), F.min("doc_id").alias("least"), F.min_by("times", "doc_id").alias("first"), F.sum(F.when(F.col("doc_id").isNull(), F.col("times")).otherwise(0)).alias("nameless"))
    least = F.min("least").over(W.partitionBy("digest"))
    fresh_rows = F.col("nameless") + F.when(F.col("least") == least, F.col("first")).otherwise(0)
    split = sums.withColumn("fresh", fresh_rows).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("fresh").alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(1 << copy_bit)).alias("mask"), (F.col("n") - F.col("fresh")).alias("n")))).alias("c"))
    return split.select("part", "c.mask", "c.n", "good", "toxic").groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def op11_filter_orders(spark, sf_dir: str) -> DataFrame:
    """Five filters over all ``documents`` in all 120 orders, by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return audit(count_cells(text_failures(docs), labels), "ABCDE")
