"""Arrow columns as flat NumPy buffers, so that text work is done on bytes in bulk."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20  # keeps a chunk's arrays in cache


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the n + 1 row offsets. Null is empty."""
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(wide) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    rows, first = len(offsets) - 1, 0
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in batches whose string or binary column has at most ``most`` bytes, or one row."""
    for batch in batches:
        _, offsets = utf8(batch.column(column))
        for a, b in chunks(offsets, most):
            yield batch.slice(a, b - a)


def words_at(data: np.ndarray, width: int, big: bool = False) -> np.ndarray:
    """A view with the ``width``-byte word that starts at every byte; pad ``data`` first."""
    kind = np.dtype(f"{'>' if big else '<'}u{width}")
    return np.ndarray((max(0, len(data) - width + 1),), kind, buffer=data, strides=(1,))


def runs(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length n, one after the other."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def bounds(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of ``solid`` bytes; rows, told by ``offsets``, end a run."""
    edge = np.zeros(len(solid) + 1, bool)
    edge[offsets] = True
    begin, end = solid & edge[:-1], solid & edge[1:]
    begin[1:] |= solid[1:] & ~solid[:-1]
    end[:-1] |= solid[:-1] & ~solid[1:]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(task: Task) -> Task:
    """``task``, which hands freed memory back at its end: Python workers live on between stages."""

    @wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run
