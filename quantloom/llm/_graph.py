"""Connected components: forests made inside tasks, then parents of parents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import tidy
from ._store import Scratch


def hubs(tops, total: int, share: int = 200, least: int = 256) -> dict[int, int]:
    """Hash of a key -> number of parts, for keys of over 1/share of ``total`` rows; ``tops`` are the answers of top_keys()."""
    counts: dict[int, int] = {}
    for top in tops:
        for key, n in top:
            counts[key] = counts.get(key, 0) + n
    return {k: -(-n * share // total) for k, n in counts.items() if n >= least and n * share > total}


def top_keys(key: str, share: int = 200):
    """An aggregate: hashes of the most frequent keys with about their counts.  A sketch, so nothing is shuffled by key."""
    return F.expr(f"approx_top_k(xxhash64({key}), {share}, 10000)")


def _dealt(left: DataFrame, right: DataFrame, key: str, parts: dict[int, int], how: str = "inner") -> DataFrame:
    """The join on ``key``, rows of a key in ``parts`` dealt out on so many tasks, where ``right``'s are repeated."""
    if not parts:
        return left.join(right, key, how)
    of = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in parts.items() for x in pair]), F.xxhash64(key)), F.lit(1))
    dealt = left.withColumn("__part", F.pmod(F.xxhash64(*left.columns), of).cast("int"))
    return dealt.join(right.withColumn("__part", F.explode(F.sequence(F.lit(0), of.cast("int") - 1))), [key, "__part"], how).drop("__part")


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` (a written table) joined with ``right`` (one row a key); frequent keys of ``left`` are dealt out on several tasks.

    Fewer than 200 keys hold over a 200th of the rows each; that bounds what the driver gets and how often rows of ``right`` are repeated.
    """
    total, top = left.agg(F.count("*"), top_keys(key)).first()
    return _dealt(left, right, key, hubs([top], total), how)


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges' nodes, but for those smallest ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while (further := root[root]).tobytes() != root.tobytes():
            root = further
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]


def _forests(edges: DataFrame, most: int = 1 << 20) -> DataFrame:
    """The edges of a task as a forest of stars, each node with the smallest one; a task holds ``most`` of them at once."""

    def run(batches):
        held, n = [], 0

        def merged():
            return forest(*(np.concatenate([h[k] for h in held]) for k in range(2)))

        for batch in batches:
            held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
            n += batch.num_rows
            if n > most:
                star = merged()
                held, n = [star], len(star[0])
                if n > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in star], names=["u", "v"])
                    held, n = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["u", "v"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(tidy(run), "u long, v long")


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", most: int = 60, task_edges: int = 50_000) -> DataFrame:
    """``(node, component)`` of every node that has an edge; the component is its smallest node.

    ``edges`` has integer columns ``u`` and ``v``; direction, loops and repeats don't matter.  Tasks make a forest
    of their edges, a node's parent being smaller.  A round replaces parents by their parents, deals the edges out by node and
    makes forests again, so that a node's several parents meet.  Each round's edges are written to the shared folder.
    A round ends the loop when it leaves the edges as they were, which a row count and an order-free checksum show: then every
    node has one parent, and that has none.  No group of neighbours is gathered in one task: a task gives a node once for every
    part of its edges, so a node has about as many parents as there are tasks, and the rows of a frequent parent are dealt out on several tasks.
    Small rounds take few tasks, one for ``task_edges`` edges.
    """
    session = edges.sparkSession
    least_tasks = 2 * session.sparkContext.defaultParallelism
    now = scratch.write(_forests(edges.where("u != v")), f"{name}-0")
    look = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), top_keys("v")).first()
    before = look(now)
    for step in range(1, most + 1):
        if not before[0]:
            break
        tasks = max(least_tasks, -(-before[0] // task_edges))
        parents = now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
        moved = _dealt(now, parents, "v", hubs(before[2:], before[0]), "left").select("u", F.coalesce("m", "v").alias("v"))
        now = scratch.write(_forests(moved.coalesce(tasks).repartition("u").coalesce(tasks)), f"{name}-{step}")
        after = look(now)
        scratch.drop(f"{name}-{step - 1}")
        if after[:2] == before[:2]:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {most} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
