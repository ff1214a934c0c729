"""Word shingles of whole texts and their XXH64 hashes, computed on byte buffers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from tarn.llm.buffers import chunks, runs, utf8, words_at

SEED = 42
LONG_SHINGLE = 256

U = np.uint64
# Fixed values of the public XXH64 algorithm.
P1, P2, P3, P4, P5 = (
    U(11400714785074694791),
    U(14029467366897019727),
    U(1609587929392839161),
    U(9650029242287828579),
    U(2870177450012600261),
)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << U(r)) | (x >> U(64 - r))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of the slices ``data[start : start + length]``, all at once."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    q8, q4 = words_at(data, 8), words_at(data, 4)
    h = np.empty(len(start), np.uint64)
    at, left = start.astype(np.int64).copy(), length.astype(np.int64).copy()
    long = left > LONG_SHINGLE
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + left[i]].tobytes(), seed)
    left[long] = 0
    h[~long] = U(seed) + P5
    striped = np.flatnonzero(left >= 32)
    if len(striped):
        s, n = at[striped], left[striped] // 32
        acc = [np.full(len(s), U((seed + add) % 2**64)) for add in (int(P1) + int(P2), int(P2), 0, -int(P1))]
        for r in range(int(n.max())):
            on = np.flatnonzero(n > r)
            for lane in range(4):
                acc[lane][on] = _round(acc[lane][on], q8[s[on] + 32 * r + 8 * lane].astype(np.uint64))
        merged = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for lane in acc:
            merged = (merged ^ _round(np.zeros_like(lane), lane)) * P1 + P4
        h[striped] = merged
        at[striped] += 32 * n
        left[striped] -= 32 * n
    h[~long] += length[~long].astype(np.uint64)
    while len(on := np.flatnonzero(left >= 8)):
        h[on] = _rotl(h[on] ^ _round(np.zeros(len(on), np.uint64), q8[at[on]].astype(np.uint64)), 27) * P1 + P4
        at[on] += 8
        left[on] -= 8
    if len(on := np.flatnonzero(left >= 4)):
        h[on] = _rotl(h[on] ^ (q4[at[on]].astype(np.uint64) * P1), 23) * P2 + P3
        at[on] += 4
        left[on] -= 4
    while len(on := np.flatnonzero(left > 0)):
        h[on] = _rotl(h[on] ^ (data[at[on]].astype(np.uint64) * P5), 11) * P1
        at[on] += 1
        left[on] -= 1
    final = h.copy()
    final ^= final >> U(33)
    final *= P2
    final ^= final >> U(29)
    final *= P3
    final ^= final >> U(32)
    return np.where(long, h, final)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised bytes, start and length of every shingle, and shingles per row."""
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    solid = (data != 32) & ((data < 9) | (data > 13))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    begins = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    size = ends - begins
    flat = np.full(int(size.sum()) + len(size), 32, np.uint8)
    flat[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[solid]
    at = np.cumsum(size + 1) - (size + 1)
    first = np.searchsorted(begins, offsets)
    count = np.diff(first)
    per_row = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    head = np.repeat(first[:-1], per_row) + runs(per_row)
    tail = head + np.repeat(np.minimum(count, words), per_row) - 1
    start = at[head]
    return flat, start, at[tail] + size[tail] - start, per_row


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    data, offsets = utf8(column)
    sets: list[np.ndarray] = []
    for a, b in chunks(offsets):
        flat, start, size, per_row = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        sets += [np.unique(h) for h in np.split(xxh64(flat, start, size).view(np.int64), np.cumsum(per_row)[:-1])]
    return sets
