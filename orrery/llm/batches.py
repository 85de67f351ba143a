"""Arrow batches inside tasks: slices of bounded size, whole groups of sorted streams, packed arrays in binary cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def column_slices(texts: pa.Array, budget: int, most: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Bounds lo, hi of rows of a string column: about `budget` bytes and at most `most` rows, one row at least."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + budget, side="right")) - 1)
        hi = min(hi, lo + most, len(texts))
        yield lo, hi
        lo = hi


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by keys without nulls: only a group and a batch are held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        end = [batch.column(k)[-1] for k in keys]
        other = np.zeros(batch.num_rows, bool)
        for k, x in zip(keys, end, strict=True):
            other |= np.asarray(pc.not_equal(batch.column(k), x))
        cut = int(other.nonzero()[0][-1]) + 1 if other.any() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        elif held and last != end:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
        last = end
    if held:
        yield pa.Table.from_batches(held)


def cells(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i has the bytes of values[bounds[i] : bounds[i + 1]]."""
    data = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def cell_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and how many each row has."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(offsets)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... (counts[i] of them), one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def run_starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
