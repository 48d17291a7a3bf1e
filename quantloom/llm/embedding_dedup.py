"""Operator 7: near-duplicate vectors by iterative quantisation and multi-index Hamming tables."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components, split_join
from ._runs import cuts, tidy, whole_runs
from ._store import Scratch

BITS = 64


class Quantiser:
    """Balanced binary codes: principal axes of centred vectors, rotated so that signs lose least (ITQ).

    ``rounds`` independent rotations give as many codes of up to BITS bits, one after another.
    """

    def __init__(self, sample: np.ndarray, rounds: int = 1, steps: int = 40, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean = sample.mean(axis=0)
        centred = sample - self.mean
        values, axes = np.linalg.eigh(np.cov(centred.T).reshape(sample.shape[1], -1))
        axes = axes[:, np.argsort(-values)[:BITS]]
        self.maps = []
        for _ in range(rounds):
            turn = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
            flat = centred @ axes
            for _ in range(steps):
                u, _, v = np.linalg.svd(np.sign(flat @ turn).T @ flat)
                turn = (u @ v).T
            self.maps.append(axes @ turn)
        self.bits = rounds * axes.shape[1]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        return np.hstack([(vectors - self.mean) @ m > 0 for m in self.maps])


def table_plan(n: int, dim: int, cosine: float, miss: float = 0.002, norms: np.ndarray | None = None, most_tables: int = 512) -> tuple[int, int, int]:
    """Bits of a block, number of blocks (tables) and rotations for ``n`` vectors.

    Blocks grow with log2(n), so buckets keep their size.  A random code bit of a pair at the bound agrees with
    probability 1 - angle/pi, where the angle is that of the centred vectors: ``norms`` are the lengths of a sample of
    unit vectors after centring (none: all 1), and a pair is taken to have equal ones.  There are as many blocks as make
    a pair without an equal block rarer than ``miss``, in the mean over the sample.  If that takes over
    ``most_tables``, blocks have no bits: all vectors of a label share one bucket, where every pair is compared.
    """
    width = int(min(24, max(8, math.ceil(math.log2(max(n, 1) / 256)) if n else 8)))
    norms = np.ones(1) if norms is None or not len(norms) else norms
    angle = np.arccos(np.clip(1 - (1 - cosine) / np.maximum(norms, 1e-9) ** 2, -1, 1))
    apart = 1 - (1 - angle / math.pi) ** width
    tables = min(BITS, dim) // width
    while (apart ** max(tables, 1)).mean() > miss:
        tables += 1
        if tables > most_tables:
            return 0, 1, 1
    tables = max(tables, 1)
    return width, tables, -(-tables * width // min(BITS, dim))


def pairs_at(sample: np.ndarray, cosine: float, most: int = 4000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors whose cosine is the bound: half move from a sampled vector in any direction, half towards another one."""
    rng = np.random.default_rng(seed)
    x = sample[rng.choice(len(sample), min(most, len(sample)), replace=False)]
    away = np.where(np.arange(len(x))[:, None] % 2, rng.normal(size=x.shape), sample[rng.integers(0, len(sample), len(x))] - x)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(away, axis=1, keepdims=True)
    good = size[:, 0] > 1e-9
    return x[good], cosine * x[good] + (1 - cosine**2) ** 0.5 * away[good] / size[good]


def measured_plan(n: int, sample: np.ndarray, cosine: float, miss: float = 0.002, most_tables: int = 512) -> tuple[int, int, Quantiser, int]:
    """Block bits, tables, quantiser and code radius for ``n`` vectors like ``sample``.

    table_plan() proposes; then pairs at the bound are coded, and tables are added until at most 2 * ``miss`` of them have no
    equal block.  The radius is six deviations above their mean Hamming distance.
    """
    norms = np.linalg.norm(sample - sample.mean(axis=0), axis=1)
    width, tables, rounds = table_plan(n, sample.shape[1], cosine, miss, norms, most_tables)
    x, y = pairs_at(sample, cosine)
    while True:
        quantiser = Quantiser(sample, rounds)
        unlike = quantiser.codes(x) != quantiser.codes(y)
        lost = unlike[:, : tables * width].reshape(len(x), tables, width).any(axis=2).all(axis=1).mean() if len(x) and width else 0.0
        if lost <= 2 * miss:
            break
        tables += -(-tables // 4)
        rounds = -(-tables * width // min(BITS, sample.shape[1]))
        if tables > most_tables:
            width, tables, rounds = 0, 1, 1
    apart = unlike.sum(axis=1)
    return width, tables, quantiser, math.ceil(apart.mean() + 6 * apart.std() + 1) if len(x) else quantiser.bits


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision and which rows are comparable at all."""
    ok = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if ok.any():
        out[ok] = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)  # a null is NaN
        with np.errstate(all="ignore"):
            scale = np.abs(out).max(axis=1, keepdims=True)  # no overflow in squares
            size = np.linalg.norm(out / scale, axis=1, keepdims=True)
            out = out / scale / size
        ok &= np.isfinite(out).all(axis=1)
        out[~ok] = 0
    return out, ok


def _first_meetings(u: np.ndarray, v: np.ndarray, keys: np.ndarray, table: int) -> np.ndarray:
    """Which of the pairs have no equal block in an earlier table."""
    return ~(keys[u, :table] == keys[v, :table]).any(axis=1) if table else np.ones(len(u), bool)


def _flag(radius: int, words: int):
    """Nodes of a bucket that have another one within the code radius which they meet in no earlier table; codes only."""

    def solve(rows: pa.Table):
        nodes, tables = rows["node"].to_numpy(), rows["t"].to_numpy()
        part, split = rows["part"].to_numpy(), rows["split"].to_numpy(zero_copy_only=False)
        codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint64).reshape(len(nodes), words)
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int32).reshape(len(nodes), -1)
        flagged = np.zeros(len(nodes), bool)
        for a, b in cuts(rows["bucket"].to_numpy()):
            for first in range(a, b if b - a > 1 else a, 512):
                own = slice(first, min(first + 512, b))
                apart = np.zeros((own.stop - first, b - a), np.uint16)
                for k in range(words):
                    apart += np.bitwise_count(codes[own, k][:, None] ^ codes[a:b, k])
                u, v = np.nonzero(apart <= radius)
                u, v = u + first, v + a
                good = u < v
                if split[a]:
                    good &= part[u] != part[v]
                u, v = u[good], v[good]
                good = _first_meetings(u, v, keys, int(tables[a]))
                flagged[u[good]] = flagged[v[good]] = True
        return pa.RecordBatch.from_arrays([rows["whole"].combine_chunks().filter(pa.array(flagged)), pa.array(tables[flagged], pa.int32()), pa.array(nodes[flagged])], names=["bucket", "t", "node"])

    def run(batches):
        for rows in whole_runs(batches, "bucket"):
            yield solve(rows)

    return tidy(run)


def _in_parts(entries: DataFrame, most: int) -> DataFrame:
    """``entries`` (bucket, node, t, ...) with ``whole`` for their bucket, dealt out as pairs of parts where it has over ``most`` rows."""
    hot = entries.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket", F.ceil(F.col("n") / (most // 2)).cast("int").alias("parts"))
    spread = entries.join(hot, "bucket", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    dealt = spread.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    dealt = dealt.select(F.col("bucket").alias("whole"), F.xxhash64("bucket", low, high).alias("bucket"), (low != high).alias("split"), "part", *[c for c in entries.columns if c != "bucket"])
    return dealt.repartition("bucket").sortWithinPartitions("bucket")


def _group_links(nodes: np.ndarray, weights: np.ndarray, vectors: np.ndarray, keys: np.ndarray, labels: np.ndarray, half: np.ndarray | None, table: int, cosine: float):
    """(node, linked vectors, smallest node of its part) for pairs of a bucket that meet in no earlier table.

    ``half`` tells the two sides of a block pair apart; only pairs across it count then.
    """
    links = np.zeros(len(nodes), np.int64)
    found_u, found_v = [], []
    for a in range(0, len(nodes), 1024):
        u, v = np.nonzero(vectors[a : a + 1024] @ vectors.T >= cosine)
        u += a
        good = (u < v) & (labels[u] == labels[v])
        if half is not None:
            good &= half[u] != half[v]
        u, v = u[good], v[good]
        first = _first_meetings(u, v, keys, table)
        u, v = u[first], v[first]
        links += np.bincount(u, weights[v], len(nodes)).astype(np.int64) + np.bincount(v, weights[u], len(nodes)).astype(np.int64)
        found_u.append(u)
        found_v.append(v)
    u, v = np.concatenate(found_u), np.concatenate(found_v)
    root = nodes.copy()
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        if (root == before).all():
            break
    own = np.flatnonzero(links)
    return nodes[own], links[own], root[own]


def _compare(cosine: float, dim: int):
    """Work through sorted rows bucket by bucket; a bucket may go on in the next batch."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def solve(rows: pa.Table):
        bucket = rows["bucket"].to_numpy()
        nodes, weights, part = rows["node"].to_numpy(), rows["m"].to_numpy(), rows["part"].to_numpy()
        keys = np.frombuffer(b"".join(rows["keys"].to_pylist()), np.int32).reshape(len(nodes), -1)
        vectors = np.frombuffer(b"".join(rows["vector"].to_pylist()), np.float64).reshape(len(nodes), dim)
        labels = rows["label"].combine_chunks().dictionary_encode().indices.to_numpy()
        tables, split = rows["t"].to_numpy(), rows["split"].to_numpy(zero_copy_only=False)
        out = [_group_links(nodes[a:b], weights[a:b], vectors[a:b], keys[a:b], labels[a:b], part[a:b] if split[a] else None, int(tables[a]), cosine) for a, b in cuts(bucket) if b - a > 1]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[k] for o in out]) if out else [], pa.int64()) for k in range(3)], schema=schema)

    def run(batches):
        for rows in whole_runs(batches, "bucket"):
            yield solve(rows)

    return tidy(run)


def near_vectors(vectors: DataFrame, scratch: Scratch, cosine: float = 0.98, sample: int = 20_000, most_bucket: int = 1024) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors are compared only under equal labels that aren't null, by cosine in double precision.  A vector that is
    null, zero, of another length than most, or holds null or non-finite components links with nothing, and
    so does a null vec_id (its component is null, it isn't kept).  Rows of equal label and vector are one
    class: they are linked with each other and count as many links as they are.  Every row is a vector of its own, also
    where a vec_id is repeated: it has its own links, and component_id is the smallest vec_id of its component.

    The rotation is learned from at most ``sample`` vectors (smallest hash of vec_id); every vector is indexed.
    Codes fall into blocks, a table each: vectors with an equal block meet, which covers all pairs within a Hamming
    distance below the number of tables and others with a probability that measured_plan() sets.  First only codes are
    shuffled; vectors follow for those that have another one within a code radius in their bucket, in the first
    table where the two meet.  Those pairs are compared by their original vectors.  A bucket of over
    ``most_bucket`` rows is compared as pairs of parts, so no task gets an unbounded group; counts and a
    spanning forest leave a task, never all its pairs.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    shape = rows.where("embedding is not null and label is not null").groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    dim, n = (shape[0]["dim"], shape[0]["n"]) if shape and shape[0]["dim"] else (1, 0)
    chosen = rows.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()["embedding"].combine_chunks()
    unit, ok = _unit(chosen, dim)
    width, tables, quantiser, radius = measured_plan(n, unit[ok], cosine) if ok.sum() > 1 else (0, 1, None, 0)
    words = -(-quantiser.bits // 64) if quantiser else 1
    shared = rows.sparkSession.sparkContext.broadcast(quantiser)

    def prepare(batches):
        for batch in batches:
            unit, ok = _unit(batch["embedding"], dim)
            bits = np.zeros((len(ok), words * 64), bool)
            if shared.value is not None:
                bits[:, : shared.value.bits] = shared.value.codes(unit)
            keys = (bits[:, : tables * width].reshape(len(ok), tables, width) << np.arange(width)).sum(axis=2).astype(np.int32)
            digest = [hashlib.blake2b(u.tobytes(), digest_size=16).digest() for u in unit]
            yield pa.RecordBatch.from_pydict({"row": batch["row"], "vec_id": batch["vec_id"], "label": batch["label"], "ok": pa.array(ok), "digest": pa.array(digest, pa.binary()), "vector": pa.array([u.tobytes() for u in unit], pa.binary()), "code": pa.array([c.tobytes() for c in np.packbits(bits, axis=1)], pa.binary()), "keys": pa.array([k.tobytes() for k in keys], pa.binary()), "blocks": pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables), pa.int32()), pa.array(keys.reshape(-1)))})

    label_type = rows.schema["label"].dataType.simpleString()
    prep = scratch.write(rows.select("row", "vec_id", "label", "embedding").mapInArrow(tidy(prepare), f"row long, vec_id long, label {label_type}, ok boolean, digest binary, vector binary, code binary, keys binary, blocks array<int>"), "prepared")
    usable = prep.where("ok and label is not null and vec_id is not null")
    # a class is named by its first row; equal vectors under one label have one
    classes = scratch.write(usable.groupBy("label", "digest").agg(F.min("row").alias("node"), F.min("vec_id").alias("id"), F.count("*").alias("m")), "classes")
    owned = usable.withColumnRenamed("row", "node").join(classes.select("node", "m"), "node")
    entries = owned.select("node", "code", "keys", F.xxhash64("label").alias("group"), F.posexplode("blocks").alias("t", "block")).select(F.xxhash64("group", "t", "block").alias("bucket"), "node", "t", "code", "keys")
    flagged = scratch.write(_in_parts(entries, most_bucket).mapInArrow(_flag(radius, words), "bucket long, t int, node long").distinct(), "flagged")
    meeting = flagged.join(owned.select("node", "label", "m", "vector", "keys"), "node")
    found = _in_parts(meeting, most_bucket).mapInArrow(_compare(cosine, dim), "node long, links long, root long")
    found = scratch.write(found, "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    placed = classes.join(counts, "node", "left").join(comps, "node", "left").select("label", "digest", "id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    placed = scratch.write(placed, "placed")
    least = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    named = scratch.write(split_join(placed, least, "component").select(F.xxhash64("label", "digest").alias("class"), "label", "digest", "n_links", "component_id"), "named")
    members = scratch.write(usable.select("vec_id", "label", "digest", F.xxhash64("label", "digest").alias("class")), "members")
    same = named.withColumnsRenamed({"label": "l", "digest": "d"})  # hashes may collide
    known = split_join(members, same, "class").where("label = l and digest = d").select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id")
    other = prep.where("not (ok and label is not null and vec_id is not null)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(other).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op7_itq_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings``."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "op7"))
