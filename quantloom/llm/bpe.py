"""Operator 8: BPE encoding and decoding with content-defined chunk reuse."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ._runs import tidy
from ._text import mix64
from ._words import WordEncoder, codes_of, word_encoder

WINDOW, MASK, LEAST, MOST = 24, (1 << 10) - 1, 256, 8192
_FACTOR = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))
_BLANK = re.compile(r"[ \n\r\t]")


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _FACTOR, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def chunk_ends(text: str) -> list[int]:
    """Cut places: after a character where the hash of the last WINDOW characters has its low bits zero.

    They depend on the text around them alone, so a passage has the same chunks in every document.  Chunks
    have LEAST to MOST characters, but for the last.
    """
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    found: list[int] = []
    for base in range(0, n, 1 << 20):  # in parts: bounded memory for very long texts
        first = max(0, base - WINDOW)
        codes = codes_of(text[first : base + (1 << 20)]).astype(np.uint64)
        up, down = _powers((1 << 20) + WINDOW + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)])])
        rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: len(sums) - WINDOW]
        found += (np.flatnonzero(mix64(rolled) & np.uint64(MASK) == 0) + WINDOW + first).tolist()
    out, last = [], 0
    for p in [*found, n]:
        while p - last > MOST:
            last += MOST
            out.append(last)
        if p - last >= LEAST or p == n and p > last:
            out.append(p)
            last = p
    return out


class ChunkEncoder:
    """Encodes each distinct chunk once and repairs the joins.

    A chunk is kept as (head, ids between, tail): head and tail are its characters before its first and after its
    last blank.  Encoding across a blank is separable, so the ids between are final.  At a join the tail
    and the next head (and whole chunks without a blank) are put together and encoded anew; the join agrees exactly
    once both sides of the re-encoded string end at a blank or at the text's end.
    """

    def __init__(self, words: WordEncoder, most_chars: int = 6_000_000):
        self.words, self.most, self.chars = words, most_chars, 0
        self.kept: dict[str, tuple[str, np.ndarray | None, str]] = {}

    def release(self) -> None:
        """Forget all chunks and words, so an idle worker holds no memory."""
        self.kept, self.chars = {}, 0
        self.words.release()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if self.chars > self.most:
            self.kept, self.chars = {}, 0
        docs, new = [], {}
        for text in texts:
            ends = chunk_ends(text)
            chunks = [text[a:b] for a, b in zip([0, *ends], ends)]
            docs.append(chunks)
            new.update((c, None) for c in chunks if c not in self.kept)
        inner = []
        for chunk in new:
            first = _BLANK.search(chunk)
            if first is None:
                new[chunk] = (chunk, None, "")
                continue
            last = max(chunk.rfind(b) for b in " \n\r\t")
            new[chunk] = (chunk[: first.start()], len(inner), chunk[last + 1 :])
            inner.append(chunk[first.start() : last + 1])
            self.chars += len(chunk)
        ids, at = self.words.encode(inner)
        for chunk, (head, k, tail) in new.items():
            self.kept[chunk] = (head, None if k is None else ids[at[k] : at[k + 1]], tail)
        joins: list[str] = []
        plans: list[list] = []
        for chunks in docs:
            plan, open_ = [], []
            for chunk in chunks:
                head, between, tail = self.kept[chunk]
                open_.append(head)
                if between is not None:
                    plan += [len(joins), between]
                    joins.append("".join(open_))
                    open_ = [tail]
            plan.append(len(joins))
            joins.append("".join(open_))
            plans.append(plan)
        ids, at = self.words.encode(joins)
        return [np.concatenate([ids[at[p] : at[p + 1]] if isinstance(p, int) else p for p in plan]) for plan in plans]


@lru_cache(2)
def chunk_encoder(file: str) -> ChunkEncoder:
    """One a Python worker: what a task has encoded serves all its documents."""
    return ChunkEncoder(word_encoder(file))


def encode_decode(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", with_ids: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and ids and decoded on demand.

    A null text is empty: no tokens, the digests of nothing.  Rows keep their partitions: nothing is shuffled.
    """
    ship(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")

    def run(batches):
        encoder = chunk_encoder(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                rows = batch.slice(k, 64)
                encoded = encoder.encode([t or "" for t in rows["text"].to_pylist()])
                decoded = [encoder.words.decode(ids) for ids in encoded]
                columns = {
                    "doc_id": rows["doc_id"], "n_tokens": pa.array([len(i) for i in encoded], pa.int64()),
                    "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in encoded],
                    "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for d in decoded],
                }
                if with_ids:
                    columns |= {"ids": pa.array([i.astype(np.int64) for i in encoded], pa.list_(pa.int64())), "decoded": decoded}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, lambda: chunk_encoder(tokenizer).release()), schema)


def op8_cdc_bpe(spark, sf_dir: str) -> DataFrame:
    """All ``documents``, encoded and decoded."""
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
