"""Two-stage suffix sorting of a block of byte strings, and repeats from adjacent prefixes.

Stage one sorts directly only the suffixes that are smaller than their
successors (type S). Stage two scans the byte buckets from the left and places
every other suffix (type L) behind its successor. Order beyond the repeat length
is left open: it cannot separate two suffixes that share that many bytes.
"""

from __future__ import annotations

import numpy as np

from tarn.llm.buffers import runs, words_at

PAD = 8


class Block:
    """Byte strings of ``windows + length - 1`` bytes, laid out one after the other."""

    def __init__(self, data: np.ndarray, windows: np.ndarray, length: int):
        size = windows + (length - 1)
        self.length, self.windows = length, windows
        self.begin = np.cumsum(size + PAD) - (size + PAD)
        self.end = self.begin + size
        self.text = np.zeros(int((size + PAD).sum()), np.uint8)
        self.text[np.repeat(self.begin, size) + runs(size)] = data
        self.words = words_at(self.text, 8, big=True)
        rises = np.diff(self.text.astype(np.int16), append=0)
        rises[self.end] = 1  # the empty suffix counts as type S
        # Half the memory of longs, where that is enough.
        kind = np.int32 if len(self.text) < 2**31 else np.int64
        here = np.arange(len(self.text), dtype=kind)
        decided = np.minimum.accumulate(np.where(rises != 0, here, len(here) - 1)[::-1])[::-1]
        self.small = rises[decided] > 0
        next_small = np.minimum.accumulate(np.where(self.small, here, len(here) - 1)[::-1])[::-1]
        last = self.begin + windows - 1
        count = next_small[last] - self.begin + 1  # up to the first directly sorted suffix
        self.owner = np.repeat(np.arange(len(windows), dtype=kind), count)
        offset = runs(count).astype(kind)
        self.at = self.begin.astype(kind)[self.owner] + offset
        self.head = offset == 0
        self.is_window = offset < windows[self.owner]
        self.offset = offset
        self.byte = self.text[self.at]
        self.direct = self.small[self.at]

    def word(self, ids: np.ndarray, depth: int) -> np.ndarray:
        return self.words[np.minimum(self.at[ids] + depth, self.end[self.owner[ids]])].astype(np.uint64)

    def sorted_small(self) -> np.ndarray:
        """Type S suffixes in order of their first ``length`` bytes."""
        order = np.flatnonzero(self.direct).astype(self.at.dtype)
        group = np.zeros(len(order), self.at.dtype)
        tied = np.arange(len(order), dtype=self.at.dtype)
        for depth in range(0, self.length, 8):
            ids, word = order[tied], self.word(order[tied], depth)
            by = np.argsort(word, kind="stable") if depth == 0 else np.lexsort((word, group[tied]))
            ids, word = ids[by], word[by]
            order[tied] = ids
            g = group[tied]
            first = np.concatenate([[True], (word[1:] != word[:-1]) | (g[1:] != g[:-1])])
            size = np.diff(np.append(np.flatnonzero(first), len(tied)))
            group[tied] = np.repeat(tied[first], size)
            tied = tied[np.repeat(size > 1, size)]
            if not len(tied):
                break
        return order

    def suffix_array(self) -> np.ndarray:
        """All suffixes in order: type S as sorted, type L induced bucket by bucket."""
        small = self.sorted_small()
        cut = np.searchsorted(self.byte[small], np.arange(257))
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        out: list[np.ndarray] = []

        def induce(scanned: np.ndarray) -> np.ndarray:
            """Type L predecessors of ``scanned``, in its order."""
            before = scanned[~self.head[scanned]] - 1
            return before[~self.direct[before]]

        def post(before: np.ndarray) -> None:
            if not len(before):
                return
            bucket = self.byte[before]
            by = np.argsort(bucket, kind="stable")
            before, bucket = before[by], bucket[by]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            for part, c in zip(np.split(before, edge[1:]), bucket[edge], strict=True):
                waiting[c].append(part)

        for c in range(256):
            wave = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, self.at.dtype)
            waiting[c] = []
            while len(wave):
                out.append(wave)
                before = induce(wave)
                same = self.byte[before] == c
                post(before[~same])
                wave = before[same]
            bucket = small[cut[c] : cut[c + 1]]
            out.append(bucket)
            post(induce(bucket))
        return np.concatenate(out)

    def repeats(self, document: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which windows stand earlier too: per suffix id, by (document, start) of each string."""
        array = self.suffix_array()
        array = array[self.is_window[array]]
        flagged = np.zeros(len(self.at), bool)
        if not len(array):
            return flagged
        same = np.ones(len(array) - 1, bool)  # the common prefix with the next one reaches the length
        for depth in [*range(0, self.length - 7, 8), self.length - 8]:
            live = np.flatnonzero(same)
            if not len(live):
                break
            at = self.at[array]
            same[live] = self.words[at[live] + depth] == self.words[at[live + 1] + depth]
        by = np.lexsort((start, document))
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(self.windows[by]) - self.windows[by]
        age = place[self.owner[array]] + self.offset[array]
        first = np.concatenate([[True], ~same])
        size = np.diff(np.append(np.flatnonzero(first), len(array)))
        flagged[array] = age != np.repeat(np.minimum.reduceat(age, np.flatnonzero(first)), size)
        return flagged
