"""Documents packed into token sequences by the sum-of-squares rule.

Texts are tokenised unit by unit: the tokenizer's splitting never reaches over a
blank or from a letter to a sign, so every distinct unit of a batch is encoded
once and its ids are copied.
Pieces are dealt into groups of a bounded size; inside a group, from the longest
down, each goes where the sum over all gaps of the squared number of open bins
with that gap becomes smallest. Bins that a group leaves well short are dissolved
and packed once more across groups.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import chunks, runs, tidy, utf8, words_at
from tarn.llm.scratch import write_table
from tarn.llm.wordhash import mix

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
GROUP_ROWS = 20_000
KEPT_UNITS = 400_000  # in each of a worker's two generations, about 50 bytes each
UNITS_AT_ONCE = 1000
CHUNK_BYTES = 1 << 20
SIGNS = b",.!?;:#%&*$()-"
OTHER_KIND = 8
FULL_ENOUGH = 0.995

U = np.uint64


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass
class UnitTable:
    """Units by hash, ascending: a second hash, and where and how many their ids are in ``flat``."""

    key: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    check: np.ndarray = field(default_factory=lambda: np.zeros(0, U))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    flat: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint32))

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each unit is or would be, and which of them are here."""
        at = np.searchsorted(self.key, key)
        there = np.minimum(at, max(0, len(self.key) - 1))
        return at, (self.key[there] == key) & (self.check[there] == check) if len(self.key) else np.zeros(len(key), bool)

    def ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of the units at these places, one after the other."""
        size = self.size[at]
        return self.flat[np.repeat(self.start[at], size) + runs(size)]

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Take units in that are not here, keys ascending; of two with one key the first stays."""
        at = np.searchsorted(self.key, key)
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        if len(self.key):
            new &= self.key[np.minimum(at, len(self.key) - 1)] != key
        start = np.cumsum(size) - size + len(self.flat)
        self.flat = np.concatenate([self.flat, flat])
        self.key, self.check = np.insert(self.key, at[new], key[new]), np.insert(self.check, at[new], check[new])
        self.start, self.size = np.insert(self.start, at[new], start[new]), np.insert(self.size, at[new], size[new])


class KnownUnits:
    """Ids of units already encoded, in two generations: the older one is dropped when the newer is full."""

    def __init__(self, path: str):
        self.tokenizer, self.new, self.old = _tokenizer(path), UnitTable(), UnitTable()

    def encode(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each unit, one after the other, and how many each has."""
        # Many units make one input of separate words: one result for all, not one for each.
        lists = [units[a : a + UNITS_AT_ONCE] for a in range(0, len(units), UNITS_AT_ONCE)]
        coded = self.tokenizer.encode_batch(lists, is_pretokenized=True, add_special_tokens=False)
        sizes = [np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)) for e, part in zip(coded, lists, strict=True)]
        return np.concatenate([np.array(e.ids, np.uint32) for e in coded]), np.concatenate(sizes)

    def __call__(self, key: np.ndarray, check: np.ndarray, units: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, size) of units given by two hashes, keys ascending; ``units`` gives the texts at some places."""
        if len(self.new.key) > KEPT_UNITS:
            self.old, self.new = self.new, UnitTable()
        _, known = self.new.find(key, check)
        at, older = self.old.find(key, check)
        older &= ~known
        if older.any():
            self.new.add(key[older], check[older], self.old.size[at[older]], self.old.ids(at[older]))
        fresh = np.flatnonzero(~known & ~older)
        if len(fresh):
            flat, size = self.encode(units(fresh))
            self.new.add(key[fresh], check[fresh], size, flat)
        at, known = self.new.find(key, check)
        start, size = self.new.start[np.where(known, at, 0)], self.new.size[np.where(known, at, 0)]
        if known.all():
            return self.new.flat, start, size
        other = np.flatnonzero(~known)  # a unit whose key another one holds is encoded each time
        extra, extra_size = self.encode(units(other))
        start[other], size[other] = len(self.new.flat) + np.cumsum(extra_size) - extra_size, extra_size
        return np.concatenate([self.new.flat, extra]), start, size


known_units = lru_cache(maxsize=2)(KnownUnits)


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, and begin and end of every unit that the tokenizer treats on its own.

    A unit ends at ASCII blanks, and between an ASCII letter and a sign of
    SIGNS: the tokenizer splits there too, whatever stands around. Signs of its
    special tokens are not among them, and a text with one keeps its case.
    """
    kind = KIND[data]
    solid = kind > 0
    turn = np.ones(len(data), bool)
    turn[1:] = (kind[1:] != kind[:-1]) & (kind[1:] + kind[:-1] != 1 + OTHER_KIND) & (kind[1:] + kind[:-1] != 2 + OTHER_KIND)
    turn[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(turn & solid)
    stop = np.append(turn[1:], True) if len(data) else turn
    end = np.flatnonzero(stop & solid) + 1
    if not (data == ord("|")).any():
        data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    return data, start, end


def _kinds() -> np.ndarray:
    """0 for blanks, 1 for ASCII letters, 2 for SIGNS, OTHER_KIND for all else, which joins with both."""
    kind = np.full(256, OTHER_KIND, np.uint8)
    kind[[32, *range(9, 14)]] = 0
    kind[65:91] = kind[97:123] = 1
    kind[np.frombuffer(SIGNS, np.uint8)] = 2
    return kind


KIND = _kinds()


def word_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all rows, one after the other, and ids per row."""
    data, start, end = units_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
    key, check = _unit_keys(data, start, end - start)
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    if (check != check[first][which]).any():  # two units of one hash: tell them apart by both
        _, first, which = np.unique(np.stack([key, check], axis=1), axis=0, return_index=True, return_inverse=True)
        which = which.ravel()
    raw = data.tobytes()

    def texts(at: np.ndarray) -> list[str]:
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[first[at]].tolist(), end[first[at]].tolist(), strict=True)]

    flat, place, size = known_units(path)(key[first], check[first], texts)
    per_unit = size[which]
    out = flat[np.repeat(place[which], per_unit) + runs(per_unit)]
    ends = np.concatenate([[0], np.cumsum(per_unit)])
    return out, np.diff(ends[np.searchsorted(start, offsets)])


def _unit_keys(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every unit."""
    word = words_at(np.concatenate([data, np.zeros(16, np.uint8)]), 8)
    low, high = np.zeros(len(start), U), np.zeros(len(start), U)
    on = np.arange(len(start))
    for depth in range(0, int(size.max()), 8):
        if depth:
            on = on[size[on] > depth]
        left = np.minimum(size[on] - depth, 8).astype(U)
        part = word[start[on] + depth].astype(U) & (U(2**64 - 1) >> (U(64) - left * U(8)))
        low[on] = mix(low[on] + part * U(0x9E3779B97F4A7C15) + left)
        high[on] = (high[on] ^ part ^ (left << U(56))) * U(0xD6E8FEB86659FD93) + U(depth + 1)
    return low, high


def _pieces(ids: np.ndarray, count: np.ndarray, capacity: int, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids with ends, row, piece, start, length): every row's ids and ``end_id``, cut every ``capacity`` ids."""
    whole = count + 1
    ended = np.full(int(whole.sum()), end_id, "<u4")
    ended[np.arange(len(ids)) + np.repeat(np.arange(len(count)), count)] = ids
    per_row = -(-whole // capacity)
    row, piece = np.repeat(np.arange(len(count)), per_row), runs(per_row)
    return ended, row, piece, piece * capacity, np.minimum(capacity, whole[row] - piece * capacity)


def _pieces_task(path: str, capacity: int, end_id: int, keep_ids: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                ids, count = word_ids(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], path)
                ended, row, piece, start, length = _pieces(ids, count, capacity, end_id)
                cut = np.cumsum(length)
                raw = [ended[i:j].tobytes() for i, j in zip((cut - length).tolist(), cut.tolist(), strict=True)]
                columns = {
                    "doc_id": batch.column(0).take(pa.array(a + row)),
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids_crc32": pa.array([crc32(x) for x in raw], pa.int64()),
                }
                if keep_ids:
                    columns["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return task


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and ``end_id``, cut every ``capacity`` ids."""
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(_pieces_task(path, capacity, end_id, keep_ids)), schema)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, in the given order, by the sum-of-squares rule.

    Moving one bin from gap g to gap g - n changes the sum by
    2 (N[g - n] - N[g]) + 2, a new bin by 2 N[capacity - n] + 1; gap 0 counts for
    nothing. Of equal choices the smallest gap wins, a new bin last.
    """
    number = np.zeros(capacity + 1, np.int64)  # open bins per gap; gap 0 stays at 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used = 0
    gaps = np.zeros(0, np.int64)  # gaps that have open bins, ascending
    for i, n in enumerate(lengths.tolist()):
        fit = gaps[np.searchsorted(gaps, n) :]
        best = -1
        if len(fit):
            change = 2 * (number[fit - n] - number[fit]) + np.where(fit == n, 1, 2)
            k = int(change.argmin())
            fresh = 2 * number[capacity - n] + 1 if n < capacity else 0
            if change[k] <= fresh:
                best = int(fit[k])
        if best < 0:
            where[i], offset[i], left = used, 0, capacity - n
            open_bin = used
            used += 1
        else:
            open_bin = open_bins[best].pop()
            number[best] -= 1
            if not number[best]:
                gaps = np.delete(gaps, np.searchsorted(gaps, best))
            where[i], offset[i], left = open_bin, capacity - best, best - n
        if left:
            if not number[left]:
                gaps = np.insert(gaps, np.searchsorted(gaps, left), left)
            number[left] += 1
            open_bins[left].append(open_bin)
    return where, offset


def _pack_task(capacity: int):
    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bin_, offset = sum_of_squares(frame["length"].to_numpy(), capacity)
        fill = np.bincount(bin_, frame["length"].to_numpy())
        frame["sequence_id"] = (frame["deal"].to_numpy(np.int64) << 32) + bin_
        frame["offset"] = offset
        frame["fill"] = fill[bin_].astype(np.int64)
        return frame

    return task


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``pieces`` with sequence_id and offset; every sequence holds at most ``capacity`` ids, gapless from 0.

    Groups are dealt by a hash of doc_id and piece and hold about ``group_rows``
    pieces, so copies and hot sources spread over all of them. The second round
    takes the sequences that the first left under FULL_ENOUGH of the capacity.
    """
    groups = max(1, -(-pieces.count() // group_rows))
    columns = pieces.columns
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", deal long, sequence_id long, offset long, fill long"

    def round_(table: DataFrame, count: int, base: int) -> DataFrame:
        deal = F.pmod(F.xxhash64(F.lit(base), "doc_id", "piece"), F.lit(count)) + F.lit(base)
        dealt = table.withColumn("deal", deal.cast("long")).select(*columns, "deal")
        return dealt.groupBy("deal").applyInPandas(_pack_task(capacity), schema)

    if groups == 1:
        return round_(pieces, 1, 0).select(*columns, "sequence_id", "offset")
    first = write_table(round_(pieces, groups, 0), "packed")
    good = F.col("fill") >= int(FULL_ENOUGH * capacity)
    loose = first.filter(~good)
    again = max(1, -(-loose.count() // group_rows))
    second = round_(loose.select(*columns), again, groups)
    return first.filter(good).unionByName(second).select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    A null or empty text is the end id alone. Only documents of more than
    ``capacity`` ids are cut. Rows that repeat a doc_id are packed each. Other
    columns are ignored; an empty table gives an empty result.
    """
    return pack(write_table(tokenised(docs, path, capacity, end_id, keep_ids), "pieces"), capacity)
