"""Operator 10: token ids in patched frame-of-reference blocks."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._runs import tidy
from ._store import Scratch
from ._text import pieces
from ._words import word_encoder

MAGIC, BLOCK = b"QPF1", 256
_HEAD = struct.Struct("<4sIIII")
_BLOCK = np.dtype([("low", "<u4"), ("width", "u1"), ("at", "<u4"), ("exc", "<u4")])


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values at ``width`` bits each, as bytes: 64 values fill ``width`` words of 64 bits."""
    lanes = np.ascontiguousarray(values.reshape(-1, 64).T).astype(np.uint64)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        k, shift = divmod(i * width, 64)
        words[k] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[k + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def _unpacked(rows: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(rows).view("<u8").reshape(-1, width).T)
    lanes, mask = np.empty((64, words.shape[1]), np.uint32), np.uint64((1 << width) - 1)
    for i in range(64):
        k, shift = divmod(i * width, 64)
        v = words[k] >> np.uint64(shift)
        if shift + width > 64:
            v = v | words[k + 1] << np.uint64(64 - shift)
        lanes[i] = v & mask
    return np.ascontiguousarray(lanes.T).reshape(len(rows), BLOCK)


def pack(ids: np.ndarray, percentile: float = 90.0) -> bytes:
    """Encode unsigned 32-bit ids.

    Layout: magic, number of ids, block length, number of blocks, bytes of packed blocks; the block index
    (minimum, width, byte where the block starts, first of its exceptions); the packed blocks; the exception
    lists: all positions (u1), then all high parts (u4).  A block is its values less the minimum, their low
    ``width`` bits packed; ``width`` is what ``percentile`` of its values need, and what a value has above
    it is an exception.  No ids make a header alone.
    """
    ids = np.asarray(ids, np.uint32)
    n_blocks = -(-len(ids) // BLOCK)
    if not n_blocks:
        return _HEAD.pack(MAGIC, 0, BLOCK, 0, 0)
    grid = np.concatenate([ids, np.full(n_blocks * BLOCK - len(ids), ids[-1], np.uint32)]).reshape(n_blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(BLOCK * percentile / 100)) - 1)
    limit = np.partition(rest, rank, axis=1)[:, rank].astype(np.float64)
    width = np.ceil(np.log2(limit + 1)).astype(np.uint32)
    above = np.where(width < 32, (np.uint64(1) << width.astype(np.uint64)), np.uint64(1 << 32))
    block, where = np.nonzero(rest >= above[:, None])
    high = (rest[block, where] >> width[block]).astype("<u4")
    index = np.zeros(n_blocks, _BLOCK)
    index["low"], index["width"] = low, width
    index["exc"] = np.searchsorted(block, np.arange(n_blocks))
    body, at = [], 0
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        index["at"][own] = at + np.arange(len(own)) * (w * BLOCK // 8)
        at += len(own) * (w * BLOCK // 8)
        if w:
            body.append(_packed(rest[own] & np.uint32((1 << w) - 1), w).tobytes())
    return _HEAD.pack(MAGIC, len(ids), BLOCK, n_blocks, at) + index.tobytes() + b"".join(body) + where.astype(np.uint8).tobytes() + high.tobytes()


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids at positions ``first`` to ``last``; the block index leads straight to the blocks that hold them."""
    magic, n, block, n_blocks, size = _HEAD.unpack_from(data)
    if magic != MAGIC or block != BLOCK:
        raise ValueError("not a block file of this format")
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    index = np.frombuffer(data, _BLOCK, n_blocks, _HEAD.size)
    body = np.frombuffer(data, np.uint8, size, _HEAD.size + index.nbytes)
    tail = _HEAD.size + index.nbytes + size
    n_exc = (len(data) - tail) // 5
    k0, k1 = first // BLOCK, -(-last // BLOCK)
    part = index[k0:k1]
    out = np.empty((k1 - k0, BLOCK), np.uint32)
    at, width = part["at"].astype(np.int64), part["width"].astype(np.int64)
    for w in np.unique(width).tolist():
        own = np.flatnonzero(width == w)
        out[own] = _unpacked(body[at[own][:, None] + np.arange(w * BLOCK // 8)], w) if w else 0
    e0, e1 = int(part["exc"][0]), int(index["exc"][k1]) if k1 < n_blocks else n_exc
    if e1 > e0:
        counts = np.diff(np.append(part["exc"].astype(np.int64), e1))
        rows = np.repeat(np.arange(k1 - k0), counts)
        where = np.frombuffer(data, np.uint8, e1 - e0, tail + e0)
        high = np.frombuffer(data, "<u4", e1 - e0, tail + n_exc + 4 * e0)
        out[rows, where] |= high << width[rows].astype(np.uint32)
    out += part["low"][:, None]
    return out.reshape(-1)[first - k0 * BLOCK : last - k0 * BLOCK]


_FILES = "part int, seg int, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
_FILES_ARROW = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])


def write_token_files(docs: DataFrame, scratch: Scratch, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, segment_ids: int = 1 << 19, percentile: float = 90.0) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; return the table of segments.

    Documents are range-partitioned and sorted on doc_id (equal ids: by text; null first), encoded in that
    order and packed into segments of about ``segment_ids`` ids.  (part, seg) orders the segments; a segment
    is one row of a Parquet table, written with Spark's commit protocol, so a lost executor leaves no half file.
    A null text is empty; every document ends with ``end_id``.
    """

    def encode(batches):
        encoder, part, seg = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []

        def segment():
            nonlocal seg
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, seg, sum(lengths), doc_ids, lengths, pack(np.concatenate(held), percentile)), _FILES_ARROW.types)], schema=_FILES_ARROW)
            seg += 1
            held.clear(), doc_ids.clear(), lengths.clear()
            return row

        for batch in batches:
            for first, last in pieces(batch["text"]):
                rows = batch.slice(first, last - first)
                ids, at = encoder.encode([t or b"" for t in rows["text"].cast(pa.binary()).to_pylist()])
                ids = np.insert(ids, at[1:], end_id)
                held.append(ids)
                doc_ids += rows["doc_id"].to_pylist()
                lengths += (np.diff(at) + 1).tolist()
                if sum(map(len, held)) >= segment_ids:
                    yield segment()
        if doc_ids:
            yield segment()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return scratch.write(ordered.mapInArrow(tidy(encode), _FILES), "files")


def read_token_files(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Per document of the written files: doc_id, start, n_tokens, ids_crc32."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    starts = files.select("part", "seg", "n_ids").join(parts.select("part", "before"), "part").select("part", "seg", (F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("n_ids").over(W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("seg_start"))
    starts = scratch.write(starts, "starts")  # one row a segment: Spark broadcasts it where its size allows
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["lengths"])
                begins = ends - row["lengths"]
                crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["seg_start"]), pa.array(row["lengths"], pa.int64()), pa.array(crcs, pa.int64())], schema=out)

    return files.join(starts, ["part", "seg"]).mapInArrow(tidy(decode), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_pfor_tokens(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` through the token files and back."""
    scratch = Scratch(spark, "op10")
    return read_token_files(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch), scratch)
