"""Operator 5: near-duplicates by MinHash, banding, verification and connected components."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, split_join
from ._runs import cuts, tidy, whole_runs
from ._store import Scratch, fresh
from ._text import mix64, pieces, shingle_sets

ROWS, BANDS = 7, 50  # at 0.8 a pair shares no band with probability 8e-6, at 0.2 it shares one with 6e-4
HASHES = ROWS * BANDS
_RNG = np.random.default_rng(19790401)
_A = (_RNG.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)[:, None]
_C = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minima of HASHES universal hash functions a*x+b over the (scrambled) shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 2**32 - 1, np.uint32)
    for k in range(0, len(x), 4096):
        np.minimum(out, (_A * x[k : k + 4096] + _B).min(axis=1), out=out)
    return out


def bands(signatures: np.ndarray) -> np.ndarray:
    """One key per row and band."""
    grid = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    return mix64((grid * _C).sum(axis=2, dtype=np.uint64) ^ _BAND).view(np.int64)


def _sketch(signatures: np.ndarray) -> np.ndarray:
    """The two lowest bits (after scrambling) of every minimum, packed: what pairs carry for their first check."""
    bits = mix64(signatures.astype(np.uint64))
    both = np.stack([bits & np.uint64(1), bits >> np.uint64(1) & np.uint64(1)], axis=2).astype(np.uint8)
    return np.packbits(both.reshape(len(signatures), -1), axis=1)


def _prepare(docs: DataFrame, k: int) -> DataFrame:
    """Per row: doc_id, n_shingles, a digest of the shingle set, band keys, sketch of the signature."""

    def run(batches):
        for batch in batches:
            for first, last in pieces(batch["text"]):
                rows = batch.slice(first, last - first)
                sizes, digests, signatures = [], [], []
                for s in shingle_sets(rows["text"], k):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    signatures.append(signature(s))
                grid = np.array(signatures, np.uint32).reshape(-1, HASHES)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(grid) * BANDS + 1, BANDS), pa.int32()), pa.array(bands(grid).reshape(-1)))
                yield pa.RecordBatch.from_pydict({"doc_id": rows["doc_id"], "n_shingles": pa.array(sizes, pa.int64()), "digest": pa.array(digests, pa.binary()), "bands": keys, "sketch": pa.array([g.tobytes() for g in _sketch(grid)], pa.binary())})

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """Per row its sorted shingle hashes, eight bytes each."""

    def run(batches):
        for batch in batches:
            for first, last in pieces(batch["text"]):
                rows = batch.slice(first, last - first)
                yield pa.RecordBatch.from_pydict({"node": rows["node"], "set": pa.array([s.tobytes() for s in shingle_sets(rows["text"], k)], pa.binary())})

    return docs.mapInArrow(tidy(run), "node long, set binary")


_BITS = np.bitwise_count(np.arange(256, dtype=np.uint8) & 0x55)


def _sketch_check(least: int):
    """Keep pairs whose sketches agree in at least ``least`` minima."""

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sketch_u", "sketch_v"))
            unlike = a ^ b
            good = HASHES - _BITS[unlike | unlike >> 1].sum(axis=1) >= least
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(good))

    return run


def _signs(sketches: np.ndarray) -> np.ndarray:
    """Three signs per minimum: rows' products are 4 * equal minima - HASHES."""
    bits = np.unpackbits(sketches, axis=1)[:, : 2 * HASHES].astype(np.float32) * 2 - 1
    return np.hstack([bits, bits[:, ::2] * bits[:, 1::2]])


def _sketch_blocks(least: int):
    """Compare, by sketch, the members outside a bucket's largest star with all members of a block.

    A spanning forest of the agreeing pairs leaves the task, never all of them.
    """

    def solve(rows: pa.Table):
        outside, node, star = (rows[c].to_numpy(zero_copy_only=False) for c in ("outside", "node", "star"))
        sketches = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint8).reshape(len(node), -1)
        out = []
        for x, y in cuts(rows["bucket"].to_numpy()):
            a, b = x + np.flatnonzero(outside[x:y]), x + np.flatnonzero(~outside[x:y])
            if not len(a) or not len(b):
                continue
            linked = _signs(sketches[a]) @ _signs(sketches[b]).T >= 4 * least - HASHES
            linked &= star[a][:, None] != star[b]
            u, v = np.nonzero(linked)
            u, v = a[u], b[v]
            root = node[x:y].copy()
            while len(u):
                low = np.minimum(root[u - x], root[v - x])
                before = root.copy()
                np.minimum.at(root, u - x, low)
                np.minimum.at(root, v - x, low)
                if (root == before).all():
                    break
            own = np.flatnonzero(root != node[x:y])
            out.append((node[x + own], root[own]))
        return [pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k in range(2)]

    def run(batches):
        for rows in whole_runs(batches, "bucket"):
            yield pa.RecordBatch.from_arrays(solve(rows), names=["u", "v"])

    return run


def _set_check(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch["set_u"].to_pylist(), batch["set_v"].to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return run


def _block_links(percent: int):
    """Links between members outside the largest component and all members of a block, none inside a component.

    Intersections are products of incidence matrices over the shingles that both sides have, taken in
    slices.  Of the members of one component that a member is linked with, the smallest stands for all.
    """

    def solve(rows: pa.Table):
        out_u, out_v = [], []
        outside, node, component, family = (rows[c].to_numpy(zero_copy_only=False) for c in ("outside", "node", "component", "family"))
        sets = [np.frombuffer(s, np.uint64) for s in rows["set"].to_pylist()]
        for x, y in cuts(rows["bucket"].to_numpy()):
            a, b = x + np.flatnonzero(outside[x:y]), x + np.flatnonzero(~outside[x:y])
            if not len(a) or not len(b):
                continue
            shared = np.intersect1d(np.concatenate([sets[k] for k in a]), np.concatenate([sets[k] for k in b]))
            both = np.zeros((len(a), len(b)), np.float32)
            at = [[np.searchsorted(shared, sets[k][np.isin(sets[k], shared, assume_unique=True)]) for k in side] for side in (a, b)]
            for first in range(0, len(shared), 8192):
                grids = []
                for places in at:
                    grid = np.zeros((len(places), 8192), np.float32)
                    for r, p in enumerate(places):
                        grid[r, p[np.searchsorted(p, first) : np.searchsorted(p, first + 8192)] - first] = 1
                    grids.append(grid)
                both += grids[0] @ grids[1].T
            sizes = [np.array([len(sets[k]) for k in side]) for side in (a, b)]
            linked = 100 * both.astype(np.int64) >= percent * (sizes[0][:, None] + sizes[1] - both.astype(np.int64))
            linked &= (component[a][:, None] != component[b]) & (family[a][:, None] == family[b])
            u, v = np.nonzero(linked)
            order = np.lexsort((node[b[v]], component[b[v]], u))
            u, v = u[order], v[order]
            keep = np.ones(len(u), bool)
            keep[1:] = (u[1:] != u[:-1]) | (component[b[v[1:]]] != component[b[v[:-1]]])
            out_u.append(node[a[u[keep]]])
            out_v.append(node[b[v[keep]]])
        return [pa.array(np.concatenate(o) if o else [], pa.int64()) for o in (out_u, out_v)]

    def run(batches):
        for rows in whole_runs(batches, "bucket"):
            yield pa.RecordBatch.from_arrays(solve(rows), names=["u", "v"])

    return run


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 2, percent: int = 80, block_shingles: int = 40_000, block_members: int = 1024, task_documents: int = 4000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a document's set has its distinct ``k``-word shingles (fewer
    words: the whole sequence; none, or a null text: empty, linked with nothing).  Documents are linked with
    100 * intersection >= percent * union; ``component_id`` is the smallest doc_id reachable.  A null doc_id
    links with nothing, has a null component and isn't kept; rows with the same doc_id share their node.

    Equal sets are one class, found by a digest, so copies never meet in pairs.  Class representatives
    with an equal band of ROWS minima are candidates.  Agreement of their sketches down to five deviations below
    the bound makes an edge, and edges make families.  Every member of a bucket is compared with one picked
    anew per bucket, which joins most into stars; in a bucket with members of several stars, those
    outside the largest are then compared with all members, as pairs of blocks of at most about ``block_members``, so
    every candidate pair is compared or already in one family.  Each member is then checked on full sets against the one of its picks that most others have,
    which joins most of a family.  Families that still are in several components are finished exactly: all their
    members outside the largest component are compared on full sets with all members, as pairs of blocks
    of bounded size whose tasks give links only.  So no group is expanded into rows for all its pairs.
    A shuffle's reading side has at most one task for ``task_documents`` documents, so many shuffle partitions with few rows don't cost a task each.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prep = scratch.write(_prepare(docs, k), "prepared")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-prep.count() // task_documents))
    put = lambda df, table: scratch.write(df.coalesce(tasks), table)
    classes = prep.where("n_shingles > 0 and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("node"))
    members = put(split_join(prep.select("doc_id", "n_shingles", "digest"), classes, "digest", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("node", "doc_id")).alias("node")), "members")
    nodes = members.where("n_shingles > 0 and node = doc_id").select("node").distinct()
    # a node's bands and sketch: of its own row; repeated doc_ids with other texts take part with each
    owned = prep.where("n_shingles > 0").withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi")
    keyed = put(owned.select("node", F.explode("bands").alias("key")), "keyed")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node")).alias("c")).where("n > 1").select("key", "n", F.col("c.node").alias("centre"))
    grouped = put(keyed.join(shared, "key").select("key", "node", "centre", "n"), "grouped")
    scratch.drop("keyed")
    stars = put(grouped.where("node != centre").select(F.col("node").alias("u"), F.col("centre").alias("v")).distinct(), "stars")
    bound = percent / 100
    agree = bound + (1 - bound) / 4  # of two bits, a quarter agree by chance
    least = int(HASHES * agree - 5 * (HASHES * agree * (1 - agree)) ** 0.5)
    side = lambda df, node, column: df.select(F.col("node").alias(node), F.col(column).alias(f"{column}_{node}"))
    sketches = owned.select("node", "sketch")
    likely = split_join(stars, side(sketches, "v", "sketch"), "v").coalesce(tasks).join(side(sketches, "u", "sketch"), "u").coalesce(tasks).mapInArrow(tidy(_sketch_check(least)), "u long, v long").distinct()
    likely = put(likely, "likely")
    # buckets whose members are in several stars (of two members, their one pair has been compared)
    joined = grouped.where("n > 2").join(components(likely, scratch, "star"), "node", "left").select("key", "node", F.coalesce("component", "node").alias("star"))
    joined = put(joined, "joined")
    most = joined.groupBy("key", "star").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "star")).alias("most"), F.count("*").alias("parts"), F.sum("n").alias("all")).where("parts > 1")
    many = lambda c: F.ceil(c / block_members).cast("int")
    most = most.select("key", F.col("most.star").alias("largest"), many(F.col("all") - F.col("most.n")).alias("na"), many(F.col("all")).alias("nb"))
    loose = joined.join(most, "key").coalesce(tasks).join(sketches, "node").coalesce(tasks).withColumn("outside", F.col("star") != F.col("largest"))
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = loose.where("outside").select("key", "node", "star", "sketch", F.lit(True).alias("outside"), part("na").alias("i"), span("nb").alias("j"))
    b = loose.select("key", "node", "star", "sketch", F.lit(False).alias("outside"), span("na").alias("i"), part("nb").alias("j"))
    dealt = a.union(b).select(F.xxhash64("key", "i", "j").alias("bucket"), "node", "star", "outside", "sketch")
    more = dealt.repartition("bucket").coalesce(tasks).sortWithinPartitions("bucket").mapInArrow(tidy(_sketch_blocks(least)), "u long, v long").distinct()
    likely = likely.union(put(more, "more-likely"))
    for name in ("stars", "grouped", "joined", "prepared"):
        scratch.drop(name)
    families = put(components(likely, scratch, "family").withColumnRenamed("component", "family"), "families")
    kin = docs.withColumnRenamed("doc_id", "node").join(families, "node", "left_semi")
    sets = scratch.write(_sets(kin.coalesce(tasks), k).where("length(set) > 0"), "sets")
    popular = likely.groupBy("v").agg(F.count("*").alias("n"))
    first = split_join(likely, popular, "v").groupBy("u").agg(F.max(F.struct("n", "v")).alias("best")).select("u", F.col("best.v").alias("v"))
    first = put(first, "first")
    links = put(split_join(first, side(sets, "v", "set"), "v").coalesce(tasks).join(side(sets, "u", "set"), "u").coalesce(tasks).mapInArrow(tidy(_set_check(percent)), "u long, v long").distinct(), "first-links")
    placed = put(families.join(components(links, scratch, "first"), "node", "left").select("node", "family", F.coalesce("component", "node").alias("component")), "placed")
    parts = placed.groupBy("family", "component").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("family", F.col("most.component").alias("largest"))
    rows = placed.join(parts, "family").join(sets, "node").select("family", "node", "component", (F.col("component") != F.col("largest")).alias("outside"), "set")
    rows = put(rows, "mixed")
    blocks = lambda c: F.ceil(F.sum(F.when(c, F.length("set")).otherwise(0)) / (8 * block_shingles)).cast("int")
    sizes = rows.groupBy("family").agg(blocks(F.col("outside")).alias("na"), blocks(F.lit(True)).alias("nb"))
    sized = rows.join(sizes, "family")
    a = sized.where("outside").select("family", "node", "component", "set", F.lit(True).alias("outside"), part("na").alias("i"), span("nb").alias("j"))
    b = sized.select("family", "node", "component", "set", F.lit(False).alias("outside"), span("na").alias("i"), part("nb").alias("j"))
    dealt = a.union(b).select(F.xxhash64("family", "i", "j").alias("bucket"), "family", "node", "component", "outside", "set")
    rest = put(dealt.repartition("bucket").coalesce(tasks).sortWithinPartitions("bucket").mapInArrow(tidy(_block_links(percent)), "u long, v long"), "other-links")
    final = components(links.union(rest), scratch, "last")
    out = members.join(final, "node", "left").select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op5_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, two-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "op5"), 2)


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (five-word shingles, 0.8); texts without words stay.

    Rows are told apart by a number of their own, so repeated rows are copies of each other, a doc_id that stands with
    two texts is judged row by row, and rows with a null doc_id take part.  Of a group the row with the smallest
    doc_id stays (null last; of equal ones the first row).
    """
    scratch, row = Scratch(spark, "dedup"), fresh("__row", docs.columns)
    rows = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), scratch, 5).select(F.col("doc_id").alias(row), "component_id")
    rank = F.struct(F.col("id").isNull().alias("none"), "id", row)
    first = found.join(rows.select(row, F.col("doc_id").cast("long").alias("id")), row).groupBy("component_id").agg(F.min(rank).alias("first")).select(F.col(f"first.{row}").alias(row))
    gone = scratch.write(found.select(row).join(first, row, "left_anti"), "gone")
    return rows.join(gone, row, "left_anti").select(*docs.columns)
