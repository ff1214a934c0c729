"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most two bits share at least six of
their eight positional bytes, and so at least two of the four byte pairs
(0,1) (2,3) (4,5) (6,7). A posting list is kept for every choice of two byte
pairs and the four byte values found there. Inside a list the shared positional
bytes of each pair are tallied, pairs that reach six are kept, and only these are
verified by their bits. A list of very many fingerprints is split by further byte
positions instead: its members are posted once more under every choice of two of
their other bytes, so that meeting there is the tally, and such a list holds
65536 fingerprints at most. Only a spanning forest of each list leaves it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import chunks, tidy, utf8
from tarn.llm.components import components
from tarn.llm.scratch import write_table
from tarn.llm.shingles import shingles, xxh64
from tarn.llm.wordhash import mix

MAX_BITS = 2
POSITIONS = 8
LEAST_SHARED = POSITIONS - MAX_BITS
SMALL_LIST = 48
LONG_LIST = 1024

U = np.uint64
PAIRS_OF_BYTES = [(0, 1), (2, 3), (4, 5), (6, 7)]
# The byte positions of a posting's key: two of the four byte pairs.
KEYS = [a + b for a, b in combinations(PAIRS_OF_BYTES, 2)]


def _ones(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the runs of ``h`` that begin at ``first``."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Eight one-byte counters are added at once; 255 rows at most keep them from carrying.
    cut = np.unique(np.concatenate([np.arange(0, len(h), 255), first]))
    packed = np.add.reduceat(bits.view(np.uint64), cut, axis=0)
    return np.add.reduceat(packed.view(np.uint8), np.searchsorted(cut, first), axis=0, dtype=np.int64)


def fingerprints(column: pa.Array, words: int = 3) -> np.ndarray:
    """The 64-bit SimHash of every text; a text without words gets zero."""
    data, offsets = utf8(column)
    out = np.zeros(len(column), np.uint64)
    for a, b in chunks(offsets):
        flat, start, length, per_row = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
        full = np.flatnonzero(per_row)
        if not len(full):
            continue
        first = (np.cumsum(per_row) - per_row)[full]
        ones = np.zeros((len(full), 64), np.int64)
        h = xxh64(flat, start, length)
        step = 1 << 19
        for lo in range(0, len(h), step):  # bounds the unpacked bits of one very long text
            hi = min(lo + step, len(h))
            rows = np.flatnonzero((first < hi) & (first + per_row[full] > lo))
            ones[rows] += _ones(h[lo:hi], np.maximum(first[rows], lo) - lo)
        on = 2 * ones > per_row[full][:, None]
        out[a + full] = np.packbits(on, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _with_fingerprint(words: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints(batch.column(1), words).view(np.int64)
            rest = batch.schema.names[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *batch.columns[2:]], names=["doc_id", "fp", *rest])

    return task


def simhash(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint as a signed long."""
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(_with_fingerprint(words)), f"doc_id {kind}, fp long")


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally: how many positional bytes the fingerprints share."""
    x = a ^ b
    return sum(((x >> U(8 * byte)) & U(255) == 0).astype(np.uint8) for byte in range(POSITIONS))


def verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def _forest(a: np.ndarray, b: np.ndarray, n: int, root: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable from each of 0..n-1 over the links a-b."""
    root = np.arange(n) if root is None else root
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while not np.array_equal(up := root[root], root):
            root = up


def _lists(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lists of equal ``keys``, which stand side by side, begin, and their sizes."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return first, np.diff(np.append(first, len(keys)))


def link_lists(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links inside lists of four shared bytes: tally the bytes of each pair, keep six and more, verify."""
    n, root = len(keys), np.arange(len(keys))
    first, size = _lists(keys)
    small = np.repeat(size <= SMALL_LIST, size)
    for d in range(1, int(size[size <= SMALL_LIST].max(initial=1))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        i = i[shared_bytes(fps[i], fps[i + d]) >= LEAST_SHARED]
        i = i[verified(fps[i], fps[i + d])]
        root = _forest(i, i + d, n, root)
    for a, m in zip(first[size > SMALL_LIST].tolist(), size[size > SMALL_LIST].tolist(), strict=True):
        own = fps[a : a + m]
        p, q = np.nonzero(np.triu(shared_bytes(own[:, None], own[None, :]) >= LEAST_SHARED, 1))
        keep = verified(own[p], own[q])
        root = _forest(p[keep] + a, q[keep] + a, n, root)
    linked = np.flatnonzero(root != np.arange(n))
    return fps[linked], fps[root[linked]]


def split_links(keys: np.ndarray, fps: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forest links inside lists of six shared bytes, which are in the tally by their key alone; ``positions`` are the other two.

    Of the 16 bits left every way to change two at most is looked up, so the work grows with the list.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for a, m in zip(*(x.tolist() for x in _lists(keys)), strict=True):
        own = np.sort(fps[a : a + m])
        bits = [U(1) << U(8 * byte + bit) for byte in range(POSITIONS) if positions[a] >> byte & 1 for bit in range(8)]
        root = np.arange(m)
        for change in [*bits, *(x | y for x, y in combinations(bits, 2))]:
            other = own ^ change
            at = np.minimum(np.searchsorted(own, other), m - 1)
            i = np.flatnonzero(own[at] == other)
            root = _forest(i, at[i], m, root)
        linked = np.flatnonzero(root != np.arange(m))
        out.append((own[linked], own[root[linked]]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (fps, fps)


def _reposted(fps: np.ndarray, key_positions: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, positions left, fp) under every choice of two more byte positions."""
    free = [p for p in range(POSITIONS) if p not in key_positions]
    keys, lefts, out = [], [], []
    for left in combinations(free, 2):
        mask = U(sum(255 << (8 * p) for p in range(POSITIONS) if p not in left))
        bits = sum(1 << p for p in left)
        keys.append(mix((fps & mask) ^ mix(np.array([bits], U))))
        lefts.append(np.full(len(fps), bits, np.int64))
        out.append(fps)
    return np.concatenate(keys), np.concatenate(lefts), np.concatenate(out)


def _rows(a: np.ndarray, b: np.ndarray, key: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    """Links (a, b), and postings for the second round as (fp, null, key, left)."""
    gone = np.concatenate([np.zeros(len(b), bool), np.ones(len(key), bool)])
    b, key, left = np.concatenate([b, np.zeros(len(key), U)]), np.concatenate([np.zeros(len(b), U), key]), np.concatenate([np.zeros(len(b), np.int64), left])
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64), mask=gone), pa.array(key.view(np.int64), mask=~gone), pa.array(left, mask=~gone)], names=["a", "b", "key", "left"])


def whole_lists(links: Callable[..., pa.RecordBatch], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run ``links`` over whole lists of rows sorted by their first column; a list may span batches."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        rows = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        held = [x[last:] for x in rows]
        if last:
            yield links(*[x[:last] for x in rows])
    if held is not None:
        yield links(*held)


def _tally_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, choice, fp) sorted by key: links of lists up to LONG_LIST, and longer ones posted once more as they pass."""
    none = np.zeros(0, U)
    passing: int | None = None  # the key of a long list whose rows are being posted again
    held = [np.zeros(0, np.int64)] * 3

    def settle(keys: np.ndarray, choice: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, size = _lists(keys)
        short = np.repeat(size <= LONG_LIST, size)
        yield _rows(*link_lists(keys[short], fps[short]), none, np.zeros(0, np.int64))
        for at, n in zip(first[size > LONG_LIST].tolist(), size[size > LONG_LIST].tolist(), strict=True):
            key, left, again = _reposted(fps[at : at + n], KEYS[int(choice[at])])
            yield _rows(again, none, key, left)

    for batch in batches:
        fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys, choice, fps = (np.concatenate(x) for x in zip(held, fresh, strict=True))
        if not len(keys):
            continue
        if passing is not None:
            done = int(np.searchsorted(keys, passing, side="right"))
            if done:
                key, left, again = _reposted(fps[:done].view(U), KEYS[int(choice[0])])
                yield _rows(again, none, key, left)
            keys, choice, fps = keys[done:], choice[done:], fps[done:]
            passing = None if len(keys) else passing
        last = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if last:
            yield from settle(keys[:last], choice[:last], fps[:last].view(U))
        held = [keys[last:], choice[last:], fps[last:]]
        if len(held[0]) > LONG_LIST:  # never held whole
            passing = int(held[0][0])
            key, left, again = _reposted(held[2].view(U), KEYS[int(held[1][0])])
            yield _rows(again, none, key, left)
            held = [np.zeros(0, np.int64)] * 3
    if len(held[0]):
        yield from settle(held[0], held[1], held[2].view(U))


def _split_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, left, fp) sorted by key: links of the split lists."""

    def links(keys: np.ndarray, left: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = split_links(keys, fps.view(U), left)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return whole_lists(links, batches)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (columns doc_id, text).

    Fingerprints at most two bits apart are linked; ``component_id`` is the
    smallest doc_id reachable over links. A null, empty or blank text has the
    fingerprint zero and is linked like any other. Repeated doc_ids are kept as
    rows. Other columns are ignored. An empty table gives an empty result.
    """
    fps = write_table(simhash(docs, words), "simhash")
    # Copies share a fingerprint: they meet once, as one row, before any pairing.
    distinct = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    masks = [sum(255 << (8 * p) for p in positions) for positions in KEYS]
    posting = [F.struct(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))).alias("key"), F.lit(i).cast("long").alias("choice")) for i, m in enumerate(masks)]
    lists = distinct.select(F.explode(F.array(*posting)).alias("p"), "fp").select("p.key", "p.choice", "fp").repartition("key").sortWithinPartitions("key", "fp")
    met = write_table(lists.mapInArrow(tidy(_tally_task), "a long, b long, key long, left long"), "simhash-tally")
    again = met.filter(F.col("key").isNotNull()).select("key", "left", F.col("a").alias("fp")).repartition("key").sortWithinPartitions("key", "fp")
    split = again.mapInArrow(tidy(_split_task), "a long, b long")
    links = write_table(met.filter(F.col("b").isNotNull()).select("a", "b").union(split).distinct(), "simhash-links")
    roots = components(links)
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = placed.join(groups, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")
