"""Tokens of whole texts and hashes of their n-grams, computed on byte buffers."""

from __future__ import annotations

import numpy as np

from tarn.llm.buffers import runs

U = np.uint64
_MIX = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The multiply-xorshift finaliser on 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _classes() -> np.ndarray:
    """0 for blanks and controls, 1 for letters and bytes beyond ASCII, 2 for digits, 3 for signs."""
    kind = np.full(256, 3, np.uint8)
    kind[:33] = 0
    kind[127] = 0
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = 1
    kind[128:] = 1
    return kind


CLASS = _classes()


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token (a run of bytes of one class, letters with their case), and tokens per row."""
    kind = CLASS[data]
    change = np.ones(len(data), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(change)
    if not len(start):
        return np.zeros(0, U), np.zeros(len(offsets) - 1, np.int64)
    size = np.diff(np.append(start, len(data)))
    power = np.cumprod(np.full(int(size.max()), _MIX | U(1)), dtype=U)
    weighed = (data.astype(U) + U(1)) * power[runs(size)]
    whole = mix(np.add.reduceat(weighed, start) + size.astype(U))
    solid = kind[start] != 0
    count = np.diff(np.searchsorted(start[solid], offsets))
    return whole[solid], count


def ngrams(token: np.ndarray, count: np.ndarray, orders: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of orders 1 to ``orders``, and the row it is in."""
    row = np.repeat(np.arange(len(count)), count)
    found, rows, rolling = [], [], np.zeros(len(token), U)
    for n in range(min(orders, max(1, len(token)))):
        rolling = mix(rolling[: len(token) - n] * _MIX + token[n:]) if n else mix(token)
        inside = row[: len(rolling)] == row[n:] if n else np.ones(len(row), bool)
        found.append((rolling[inside] >> U(64 - bits)).astype(np.int64))
        rows.append(row[: len(rolling)][inside])
    return np.concatenate(found), np.concatenate(rows)
