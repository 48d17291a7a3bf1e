"""Operator 3: benchmark decontamination by SimHash of item-sized windows."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._runs import tidy
from ._store import with_string_text
from ._text import column_bytes, hash_spans, pieces, shingle_hashes, word_spans

K = 5
WIDTHS = (11, 11, 11, 11, 10, 10)  # bits of the six fingerprint blocks
RADIUS = 17  # 17 // 6 = 2: some block of two such fingerprints differs in at most 2 bits
NEAR = 2
_GAP = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
_SHIFTS = np.arange(64, dtype=np.uint64)


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased, and row offsets."""
    data, offsets = column_bytes(column)
    starts, ends, rows = word_spans(data, offsets, _GAP)
    return hash_spans(data, starts, ends), rows


def _signs(shingles: np.ndarray) -> np.ndarray:
    return ((shingles[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int32) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64) << _SHIFTS).sum(axis=1, dtype=np.uint64)


def _block_keys(prints: np.ndarray):
    at = 0
    for width in WIDTHS:
        yield width, ((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64)
        at += width


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of minima by sum of maxima of two bags of shingles; a shingle's weight is how often it stands there."""
    keys, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(inverse[: len(a)], minlength=len(keys)), np.bincount(inverse[len(a) :], minlength=len(keys))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


class ItemIndex:
    """Items by window size, with multi-index Hamming tables: every item stands under all block keys within NEAR bits."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, rows = normal_words(pa.array(texts, pa.string()))
        self.ids, self.shingles, self.sizes = [], [], []
        for i, a, b in zip(ids, rows[:-1].tolist(), rows[1:].tolist()):
            if b > a:
                self.ids.append(i)
                self.sizes.append(b - a)
                self.shingles.append(shingle_hashes(words[a:b], min(K, b - a)))
        self.prints = np.array([_fingerprints(_signs(s).sum(axis=0)[None])[0] for s in self.shingles], np.uint64)
        self.by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        sizes = np.array(self.sizes)
        for w in np.unique(sizes).tolist():
            own, tables = np.flatnonzero(sizes == w), []
            for width, keys in _block_keys(self.prints[own]):
                masks = np.array([sum(1 << p for p in c) for r in range(NEAR + 1) for c in combinations(range(width), r)])
                near = (keys[:, None] ^ masks).reshape(-1)
                order = np.argsort(near, kind="stable")
                tables.append((np.searchsorted(near[order], np.arange((1 << width) + 1)), np.repeat(own, len(masks))[order]))
            self.by_size[w] = tables
        self.known = {k: np.unique(np.concatenate([s for s, w in zip(self.shingles, self.sizes) if min(K, w) == k])) for k in {min(K, w) for w in self.sizes}}
        self.maybe = {}
        for k, known in self.known.items():
            self.maybe[k] = np.zeros(1 << 22, bool)
            self.maybe[k][known >> np.uint64(42)] = True

    def hits(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """Where a shingle of some item stands, by shingle length."""
        out = {}
        for k, known in self.known.items():
            runs = shingle_hashes(words, k)
            at = np.flatnonzero(self.maybe[k][runs >> np.uint64(42)])
            at = at[known[np.minimum(np.searchsorted(known, runs[at]), len(known) - 1)] == runs[at]]
            out[k] = at
        return out

    def candidates(self, prints: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item of w words) within RADIUS: looked up block by block, then compared in full."""
        found = []
        for (starts, items), (_, keys) in zip(self.by_size[w], _block_keys(prints)):
            n = starts[keys + 1] - starts[keys]
            if total := int(n.sum()):
                windows = np.repeat(np.arange(len(prints)), n)
                at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[keys], n)
                found.append(windows * len(self.ids) + items[at])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        windows, items = np.divmod(np.unique(np.concatenate(found)), len(self.ids))
        near = np.bitwise_count(prints[windows] ^ self.prints[items]) <= RADIUS
        return windows[near], items[near]

    def matches(self, words: np.ndarray, hits: dict[int, np.ndarray] | None, least: float) -> dict[int, tuple[float, int]]:
        """Best similarity and its place for each item that some window of the text reaches ``least`` with.

        Without ``hits`` all windows are fingerprinted; with them those that can reach ``least`` at all.
        """
        best: dict[int, tuple[float, int]] = {}
        for w in self.by_size:
            k = min(K, w)
            n = w - k + 1
            if w > len(words):
                continue
            starts = np.arange(len(words) - w + 1)
            if hits is not None:
                # a window of n shingles can reach ``least`` only if so many of them are some item's
                own = hits[k]
                starts = np.unique((own[:, None] - np.arange(n)).reshape(-1))
                starts = starts[(starts >= 0) & (starts <= len(words) - w)]
                inside = np.searchsorted(own, starts + n) - np.searchsorted(own, starts)
                starts = starts[inside >= least * n - 1e-9]
            cuts = np.flatnonzero(np.diff(starts) > 4 * w) + 1
            for part in np.split(starts, cuts):
                done = 0
                while done < len(part):  # slices of bounded length, however far windows reach
                    s = part[done : int(np.searchsorted(part, part[done] + 8192))]
                    done += len(s)
                    runs = shingle_hashes(words[s[0] : s[-1] + w], k)
                    sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_signs(runs), axis=0, dtype=np.int32)])
                    prints = _fingerprints(sums[s - s[0] + n] - sums[s - s[0]])
                    for window, item in zip(*(x.tolist() for x in self.candidates(prints, w))):
                        at = int(s[window])
                        similarity = weighted_similarity(runs[at - s[0] : at - s[0] + n], self.shingles[item])
                        if similarity >= least - 1e-12 and similarity > best.get(item, (0.0, 0))[0]:
                            best[item] = (similarity, at)
        return best


def _row_matches(batch: pa.RecordBatch, index: ItemIndex, least: float, prefilter: bool):
    """(row, item number, similarity, word position) of a batch with a text column."""
    for first, last in pieces(batch["text"]):
        words, rows = normal_words(batch["text"].slice(first, last - first))
        if not len(words) or not index.ids:
            continue
        hits, touched = None, np.arange(last - first)
        if prefilter:
            hits = index.hits(words)
            touched = np.unique(np.concatenate([np.searchsorted(rows, at, "right") - 1 for at in hits.values()]))
        for r in touched.tolist():
            a, b = int(rows[r]), int(rows[r + 1])
            own = None if hits is None else {k: at[np.searchsorted(at, a) : np.searchsorted(at, b - k, "right")] - a for k, at in hits.items()}
            for item, (similarity, at) in index.matches(words[a:b], own, least).items():
                yield first + r, item, similarity, at


def item_blocks(items: DataFrame, block_bytes: int = 4 << 20):
    """The items (item_id, text) in blocks of about ``block_bytes`` of text, each small enough to broadcast."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text") + 200)).first()[0] or 0
    n = 1 + total // block_bytes
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        if rows:
            yield ItemIndex([r["item_id"] for r in rows], [r["text"] for r in rows])


def contaminated(docs: DataFrame, items: DataFrame, least: float = 0.8, block_bytes: int = 4 << 20, prefilter: bool = True) -> DataFrame:
    """Pairs of ``docs`` (doc_id, text) and ``items`` (item_id, text): doc_id, item_id, similarity, first_word.

    A window has as many words as the item (words: runs of ASCII letters and digits and non-ASCII characters, A-Z
    lower-cased).  Windows and items get 64-bit SimHash fingerprints of their ``K``-word shingles (an item with
    fewer words is one shingle); all pairs within RADIUS bits come out of the multi-index tables and are
    verified by exact weighted-shingle similarity of at least ``least``.  With ``prefilter`` windows of which too few
    shingles stand in any item aren't fingerprinted; they can't reach the bound, so without it the pairs are the same.
    Pairs at exactly 0.8 differ in 9.7 of 64 bits on average, and a window of such a pair is found with probability 0.996.

    Null and empty texts match nothing; a null doc_id is reported as null; repeated rows give repeated pairs.
    Documents keep their partitions: nothing is shuffled.  Items are broadcast in blocks of bounded size, each with
    a pass of its own.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ship(docs.sparkSession)
    out = None
    for index in item_blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            index = shared.value
            for batch in batches:
                found = list(_row_matches(batch, index, least, prefilter))
                rows = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].take(rows), "item_id": pa.array([index.ids[f[1]] for f in found], pa.int64()), "similarity": pa.array([f[2] for f in found], pa.float64()), "first_word": pa.array([f[3] for f in found], pa.int64())})

        part = docs.mapInArrow(tidy(run), "doc_id long, item_id long, similarity double, first_word long")
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, first_word long")


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.8, block_bytes: int = 4 << 20, prefilter: bool = True) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; all columns pass through as they are."""
    ship(docs.sparkSession)
    columns = docs.columns
    docs, name = with_string_text(docs)
    for index in item_blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                texts = pa.RecordBatch.from_arrays([batch[name]], names=["text"])
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in _row_matches(texts, shared.value, least, prefilter)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(tidy(run), docs.schema)
    return docs.select(*columns)


def op3_simhash_decontam(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def decontam_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
