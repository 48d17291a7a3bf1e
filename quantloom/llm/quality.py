"""Operator 6: quality by random-indexing word vectors and a two-layer network."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runs import give_back, tidy
from ._store import Scratch, with_string_text
from ._text import column_bytes, hash_spans, pieces, word_spans

BUCKETS, DIM, NONZERO, REACH = 1 << 14, 48, 4, 2
HIDDEN, EPOCHS, BATCH = 32, 40, 256
_RNG = np.random.default_rng(20020601)
_AT = np.array([_RNG.choice(DIM, NONZERO, replace=False) for _ in range(BUCKETS)])
_SIGN = _RNG.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32)
# kinds of bytes: 0 blank, 1 lower-case letter, 2 upper-case letter, 3 digit, 4 other sign, 5 beyond ASCII
_KIND = np.full(256, 4, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5


def word_buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of the pieces of all texts, and row offsets.

    A piece is a run of letters (an all-capital run of two or more has buckets of its own), of digits or
    of other signs; letters are hashed without case.
    """
    data, offsets = column_bytes(column)
    kind = _KIND[data]
    letters = (kind == 1) | (kind == 2) | (kind == 5)
    group = np.where(letters, 1, kind)
    begin = np.ones(len(data), bool)
    begin[1:] = group[1:] != group[:-1]
    begin[offsets[(offsets > 0) & (offsets < len(data))]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], len(data)).astype(np.int64)
    visible = group[starts] != 0
    starts, ends = starts[visible], ends[visible]
    capitals = np.concatenate([[0], np.cumsum(kind == 2)])
    loud = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    hashes = hash_spans(data, starts, ends) ^ (loud.astype(np.uint64) << np.uint64(63))
    return (hashes >> np.uint64(64 - 14)).astype(np.int64), np.searchsorted(starts, offsets)


def _contexts(docs: DataFrame) -> DataFrame:
    """Per task and bucket the sum of the index vectors of the words around its words (REACH to either side)."""

    def run(batches):
        total = np.zeros(BUCKETS * DIM)
        n = np.zeros(BUCKETS)
        for batch in batches:
            for first, last in pieces(batch["text"], 1 << 20):
                words, rows = word_buckets(batch["text"].slice(first, last - first))
                row = np.repeat(np.arange(last - first), np.diff(rows))
                n += np.bincount(words, minlength=BUCKETS)
                for reach in range(1, REACH + 1):
                    same = row[reach:] == row[:-reach]
                    a, b = words[:-reach][same], words[reach:][same]
                    for x, y in ((a, b), (b, a)):
                        for k in range(NONZERO):
                            total += np.bincount(x * DIM + _AT[y, k], _SIGN[y, k], BUCKETS * DIM)
        seen = np.flatnonzero(n)
        if len(seen):
            rows = total.reshape(BUCKETS, DIM)[seen]
            # integers below 2**53: sums don't depend on their order
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen), "n": pa.array(n[seen].astype(np.int64)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, DIM), pa.int32()), pa.array(rows.reshape(-1)))})

    parts = docs.select("text").mapInArrow(tidy(run), "bucket long, n long, vector array<double>")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("vector")[k]) for k in range(DIM)]).alias("vector"))


class WordVectors:
    """Context sums scaled to unit length, and log shares of the buckets; BUCKETS rows at any corpus size."""

    def __init__(self, rows: pa.Table):
        self.vectors, counts = np.zeros((BUCKETS, DIM), np.float32), np.zeros(BUCKETS)
        at = rows["bucket"].to_numpy()
        if len(at):
            self.vectors[at] = rows["vector"].combine_chunks().flatten().to_numpy().reshape(-1, DIM)
            counts[at] = rows["n"].to_numpy()
        mean = (self.vectors.sum(axis=0) / max(1.0, np.abs(self.vectors).sum())).astype(np.float32)
        size = np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.vectors = self.vectors / np.maximum(size, 1e-9) - mean
        self.commonness = np.log((counts + 1) / (counts.sum() + BUCKETS)).astype(np.float32)

    def pool(self, column: pa.Array) -> np.ndarray:
        """Per text: mean and spread of its words' vectors, of their commonness, the share of distinct and
        of repeated neighbours, and log length; an empty text is all zero."""
        out = np.zeros((len(column), 2 * DIM + 5), np.float32)
        for first, last in pieces(column, 1 << 18):
            words, rows = word_buckets(column.slice(first, last - first))
            n = np.diff(rows)
            full = np.flatnonzero(n)
            if not len(full):
                continue
            cut, n = rows[:-1][full], n[full].astype(np.float32)
            v = self.vectors[words]
            mean = np.add.reduceat(v, cut, axis=0) / n[:, None]
            square = np.add.reduceat(v * v, cut, axis=0) / n[:, None]
            common = self.commonness[words]
            row = np.repeat(np.arange(len(full)), n.astype(np.int64))
            distinct = np.bincount(np.unique(row * BUCKETS + words) // BUCKETS, minlength=len(full))
            again = np.bincount(row[1:][(words[1:] == words[:-1]) & (row[1:] == row[:-1])], minlength=len(full))
            f1 = np.add.reduceat(common, cut) / n
            f2 = np.add.reduceat(common * common, cut) / n - f1 * f1
            out[first + full] = np.column_stack([mean, np.sqrt(np.maximum(square - mean * mean, 0)), f1, np.sqrt(np.maximum(f2, 0)), distinct / n, again / n, np.log(n)])
        return out


class Network:
    """Two layers, trained with Adam on log loss; a temperature fitted on a tenth of the rows scales the logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.temperature = x.mean(axis=0), x.std(axis=0) + 1e-4, 1.0
        x = (x - self.mean) / self.scale
        order = rng.permutation(len(x))
        rest, train = order[: len(x) // 10], order[len(x) // 10 :]
        p = self.p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, step = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
        for _ in range(EPOCHS):
            for own in np.array_split(rng.permutation(train), -(-len(train) // BATCH)):
                h = np.maximum(x[own] @ p[0] + p[1], 0)
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[own]) / len(own)
                back = d[:, None] * p[2] * (h > 0)
                step += 1
                for k, g in enumerate((x[own].T @ back + 1e-4 * p[0], back.sum(axis=0), h.T @ d, d.sum(keepdims=True))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] -= 0.003 * m[k] / (1 - 0.9**step) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        if len(rest):
            z = self._logits(x[rest])
            loss = lambda t: np.logaddexp(0, -z / t * (2 * y[rest] - 1)).mean()
            self.temperature = float(min(np.geomspace(0.5, 8, 81), key=loss))

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logits((x - self.mean) / self.scale) / self.temperature, -30, 30)))


class Judge:
    """Word vectors and network; without any labelled row (or with one class only) every score is the label's share, 0.5 if none."""

    def __init__(self, vectors: WordVectors, x: np.ndarray, y: np.ndarray):
        self.vectors, self.share = vectors, float(y.mean()) if len(y) else 0.5
        self.network = Network(x, y) if len(np.unique(y)) > 1 else None

    def __call__(self, column: pa.Array) -> np.ndarray:
        return self.network.score(self.vectors.pool(column)).astype(np.float64) if self.network else np.full(len(column), self.share)


def _fold(column: str):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4


def fit(docs: DataFrame, labels: DataFrame, sample: int = 40_000) -> Judge:
    """Word vectors from all texts; the network from at most ``sample`` labelled rows outside the held-out fold.

    The sample are the rows with the smallest hash of their doc_id, so it is the same in every run.  Labels that
    are null or whose document is missing don't take part; of several labels of a document one counts.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    vectors = WordVectors(_contexts(texts).toArrow())
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").where(_fold("doc_id") != 2)
    chosen = known.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            x = shared.value.pool(batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "quality": batch["quality"], "x": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.reshape(-1)))})

    rows = texts.join(chosen, "doc_id").mapInArrow(tidy(run), "doc_id long, quality int, x array<float>").toArrow().sort_by([("doc_id", "ascending")])
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 2 * DIM + 5))
    judge = Judge(vectors, x.astype(np.float64), rows["quality"].to_numpy().astype(np.float64))
    del rows, x
    give_back()
    return judge


def score_quality(docs: DataFrame, judge: Judge, threshold: float = 0.7) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.  A null text is scored as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(judge)

    def run(batches):
        for batch in batches:
            score = shared.value(batch["text"])
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(score), "predicted": pa.array((score >= threshold).astype(np.int32))})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (_fold("doc_id") == 2).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, judge: Judge, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold`` (all, if nothing could be learned); columns pass through as they are."""
    if judge.network is None:
        return docs
    shared, columns = docs.sparkSession.sparkContext.broadcast(judge), docs.columns
    with_text, name = with_string_text(docs)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value(batch[name]) >= threshold))

    return with_text.mapInArrow(tidy(run), with_text.schema).select(*columns)


def op6_ri_quality(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, judged as ``labels.quality`` marks them."""
    Scratch(spark, "op6")  # sends the package along
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier rejects."""
    Scratch(spark, "quality")
    return keep_quality(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
