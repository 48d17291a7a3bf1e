"""Exact statistics of whole texts, a column of bytes at a time."""

from __future__ import annotations

import numpy as np

from ._text import mix64

_RNG = np.random.default_rng(20260301)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _PART = 0xA0761D6478BD642F, 1 << 18
_INV = pow(_BASE, -1, 2**64)
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(_PART, b, np.uint64)])) for b in (_BASE, _INV))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, by their bytes alone and with regard to case.  Starts and ends ascend.

    A running sum goes over the bytes in parts and only its values at the spans' ends are kept: memory goes by spans, not by bytes.
    """
    first, last = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    back = np.zeros(len(starts), np.uint64)
    carry = np.zeros(1, np.uint64)
    for base in range(0, len(data) + 1, _PART):
        part = data[base : base + _PART]
        sums = np.empty(len(part) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE[part] * _UP[: len(part)], out=sums[1:])
        sums = sums * np.uint64(pow(_BASE, base, 2**64)) + carry
        a, b = np.searchsorted(starts, [base, base + _PART])
        first[a:b] = sums[starts[a:b] - base]
        back[a:b] = _DOWN[starts[a:b] - base] * np.uint64(pow(_INV, base, 2**64))
        a, b = np.searchsorted(ends, [base, base + _PART])
        last[a:b] = sums[ends[a:b] - base]
        carry = sums[-1:]
    return mix64((last - first) * back + (ends - starts).astype(np.uint64))


def per_row(hit: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row ``hit`` marks."""
    if len(offsets) == 2:
        return np.array([np.count_nonzero(hit)])
    return np.diff(np.searchsorted(np.flatnonzero(hit), offsets))


def repeats(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item, whether an earlier item of its row is equal, and whether any other one is; ``rows`` ascend."""
    order = np.argsort(hashes, kind="stable")
    h, r = hashes[order], rows[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    group = np.cumsum(new) - 1
    earlier, other = np.empty(len(h), bool), np.empty(len(h), bool)
    earlier[order] = ~new
    other[order] = np.bincount(group)[group] > 1 if len(h) else False
    return earlier, other
