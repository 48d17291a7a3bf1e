"""Joins with one row a key, where a key may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh

SENT, SHARE = 50_000, 200  # rows of a small side that is broadcast; a key is frequent from 1 / SHARE of the rows


def frequent_keys(rows: DataFrame, keys: list[str], share: int = SHARE) -> dict[int, int]:
    """Hash of a key -> number of tasks, for keys with over 1 / ``share`` of ``rows``.

    A sketch in one pass, nothing is shuffled by key; fewer than ``share`` keys can be so frequent.
    """
    total, top = rows.select(F.xxhash64(*keys).alias("h")).agg(F.count("*"), F.expr(f"approx_top_k(h, {share}, 10000)")).first()
    return {h: -(-n * share // total) for h, n in top or [] if n * share > total}


def attach_rows(rows: DataFrame, small: DataFrame, keys: list[str], n_small: int | None = None, sent: int = SENT, frequent: dict[int, int] | None = None) -> DataFrame:
    """``rows`` left-joined with ``small`` (one row a key; NULL keys are keys) on columns of equal names.

    Up to ``sent`` rows of ``small`` are broadcast.  Beyond that both sides are shuffled, rows of frequent keys dealt out on
    several tasks, where ``small``'s row is repeated; pass ``frequent`` where it is known, else ``rows`` are looked through.
    """
    n_small = small.count() if n_small is None else n_small
    taken = [*rows.columns, *small.columns]
    names = [fresh(f"__key{k}", taken) for k in range(len(keys))]
    right = small.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in small.columns if c not in keys])
    met: Column = F.lit(True)
    for k, n in zip(keys, names):
        met = met & F.col(k).eqNullSafe(F.col(n))
    if n_small <= sent:
        return rows.join(F.broadcast(right), met, "left").drop(*names)
    parts = frequent_keys(rows, keys) if frequent is None else frequent
    if not parts:
        return rows.join(right, met, "left").drop(*names)
    a, b = fresh("__part", taken), fresh("__parts", taken)
    table = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])
    tasks = lambda own: F.coalesce(F.element_at(table, F.xxhash64(*own)), F.lit(1))
    dealt = rows.withColumn(a, F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), tasks(keys)).cast("int"))
    right = right.withColumn(b, F.explode(F.sequence(F.lit(0), tasks(names).cast("int") - 1)))
    return dealt.join(right, met & (F.col(a) == F.col(b)), "left").drop(a, b, *names)
