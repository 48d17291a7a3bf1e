"""What tasks share: groups of sorted rows, one at a time, and memory that goes back when a task ends."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa

from ._text import drop_powers


def whole_runs(batches, key: str):
    """Tables of rows sorted by ``key``, cut only where its value changes; what may go on in the next batch is held back."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        values = rows[key].to_numpy()
        other = np.flatnonzero(values != values[-1])
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            yield rows.slice(0, last).combine_chunks()
        held = rows.slice(last)
    if held is not None:
        yield held.combine_chunks()


def cuts(values: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal neighbouring values."""
    at = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(at, at[1:]))


def give_back() -> None:
    """Hand freed memory back to the system."""
    drop_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def keep_freed(most: int = 64 << 20) -> None:
    """Let this process keep so many freed bytes for its next arrays, until give_back().

    Else glibc returns them after each step of a loop over large arrays, and their pages are mapped and cleared anew.
    """
    tune = getattr(ctypes.CDLL(None), "mallopt", None)
    if tune is not None:
        tune(-1, most)  # M_TRIM_THRESHOLD
        tune(-3, most // 4)  # M_MMAP_THRESHOLD


def tidy(run, release=None):
    """``run``, a function of Arrow batches, that gives freed memory back to the system when its task ends.

    Spark reuses Python workers, so what one keeps adds up with what later stages need on the executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            if release is not None:
                release()
            give_back()

    return wrapped
