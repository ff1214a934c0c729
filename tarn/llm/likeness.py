"""Texts alike in their word shingles, by a byte-position inverted index with count filtering.

Two texts at a Jaccard similarity of 0.8 differ in some ten bits of a 64-bit
SimHash and so share no byte for sure; the positional bytes here are taken from
the smallest seeded hashes of the shingles instead, each equal with the
probability of the similarity. A text is posted under every group of four
neighbouring positions. In a posting list the shared positional bytes of each pair
are tallied; pairs that reach the least count, and whose parity bits allow the
similarity, are compared exactly by their sets of shingles. Members of longer lists
are first met with few others, and only lists left unresolved are passed on. A list
of over LONG_LIST texts is not met whole at first: its members are compared with the first
ones and with those of their block as the list streams by, which joins copies; if
several groups are left, members are posted again under three further positional
bytes, and lists still long once more under three others.

The index finds 99.5 % of the pairs at the bound and more above it; if every list of
a pair were split twice, 98.7 % at the bound and 99.9 % at 0.85. Lists still long
after two splits are compared whole, and their
work grows with the square of the list. ``exact`` adds
what it may leave: every text's first shingles in one order for all texts, of which
two texts at the bound share one at least, are met in lists that join groups that
are still apart. Long texts share some rare shingle with many others, so these pairs are
held against their counts of shingles by slices of the hashes before their texts travel.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import portions, tidy, utf8
from tarn.llm.components import components
from tarn.llm.scratch import write_table
from tarn.llm.shingles import shingle_sets
from tarn.llm.wordhash import mix

POSITIONS, GROUP = 40, 4  # bytes of a text's mark, and of a posting's key
LEAST_SHARED = 22  # bytes; 99.99 % of the pairs at 0.8 share so many
SHORT_LIST, BLOCK = 4, 2048
LONG_LIST, ANCHORS = 1024, 256  # members from which a list is split, and first members that all others of it meet
SPLIT, SPLITS = 3, 2  # further bytes in the key of a split list, and times a list is split
PAIRS_AT_ONCE = 64  # whose texts are unpacked together
PARTNERS = 1  # of each member of a longer list in the first round: chains join a group, the next round finds it whole
MORE_PARTNERS = 8  # times as many in every further round
SLICES, PLANES = 512, 4  # slices of each set of shingles, and bits of the count of each; the first is its parity
PAIRS_REFINED = 1 << 16  # whose counts are compared together
ORDER_TEXTS, ORDER_LEAST, ORDER_MOST = 5000, 3, 1 << 17  # only order the shingles: any order finds all pairs

U = np.uint64
SEEDS = mix(np.arange(1, POSITIONS + 1, dtype=U)) | U(1)
MARK = [f"m{k}" for k in range(POSITIONS // 8)]
PARITY = [f"s{k}" for k in range(SLICES // 64)]
COUNTS = [*PARITY, *[f"c{k}" for k in range((PLANES - 1) * SLICES // 64)]]
SKETCH = [*MARK, *PARITY]
# For each group of positions, the positions outside it by SPLIT.
FURTHER = np.array([[p for p in range(POSITIONS) if p // GROUP != g] for g in range(POSITIONS // GROUP)]).reshape(POSITIONS // GROUP, -1, SPLIT)

Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def positional_bytes(sets: list[np.ndarray]) -> np.ndarray:
    """For each set POSITIONS bytes, each of the smallest of its hashes under one seed, as longs; zero for an empty set."""
    out = np.zeros((len(sets), POSITIONS), np.uint8)
    full = np.flatnonzero([len(x) for x in sets])
    if len(full):
        flat = np.concatenate([sets[i] for i in full]).view(U)
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for k, seed in enumerate(SEEDS):
            out[full, k] = (np.minimum.reduceat(flat * seed, first) * U(0x9E3779B97F4A7C15)) >> U(56)
    return out.view(np.int64)


def prefix(grams: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first of the ``grams`` in one order for all sets, rare ones ahead of ``common`` ones.

    Two sets of that Jaccard similarity have ``similarity`` times the size of either
    in common, so the first element they share is among the first of both.
    """
    size = len(grams) - int(np.ceil(similarity * len(grams) - 1e-9)) + 1 if len(grams) else 0
    at = np.minimum(np.searchsorted(common, grams), max(0, len(common) - 1))
    often = common[at] == grams if len(common) else np.zeros(len(grams), bool)
    last = grams[often][np.argsort(rank[at[often]])]
    return np.concatenate([grams[~often], last])[:size]


def parity(grams: np.ndarray) -> np.ndarray:
    """For each of SLICES slices of the hashes whether an odd number of the ``grams`` is in it."""
    odd = np.bincount((grams.view(U) % U(SLICES)).astype(np.int64), minlength=SLICES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def counts(grams: np.ndarray) -> np.ndarray:
    """How many of the ``grams`` are in each of SLICES slices of the hashes, as PLANES rows of bits; the first is their parity."""
    held = np.bincount((grams.view(U) % U(SLICES)).astype(np.int64), minlength=SLICES)
    return np.concatenate([np.packbits((held >> k & 1).astype(np.uint8)) for k in range(PLANES)]).view(np.int64)


def apart_by_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows of ``counts``, as unsigned, the sum over all slices of the shorter way round from one count to the other.

    Counts are known modulo 2 ** PLANES; an element of one set only moves one count by one, so the sum
    is at most the number of such elements. All is done on the rows of bits.
    """
    gap, lent = [], np.zeros_like(a[..., : a.shape[-1] // PLANES])
    for x, y in zip(np.split(a, PLANES, axis=-1), np.split(b, PLANES, axis=-1), strict=True):
        gap.append(x ^ y ^ lent)
        lent = (~x & y) | (~(x ^ y) & lent)
    # Differences over a half of the circle are turned round: their bits are inverted and one is added.
    carry, total = gap[-1], 0
    for k, d in enumerate(gap[:-1]):
        turned = d ^ gap[-1]
        total = total + (np.bitwise_count(turned ^ carry).astype(np.int64).sum(axis=-1) << k)
        carry = turned & carry
    return total + (np.bitwise_count(carry).astype(np.int64).sum(axis=-1) << PLANES - 1)


def counts_allow(similarity: float) -> Near:
    """Which of (size, COUNTS) can have that Jaccard similarity; no pair that has it is ruled out.

    Parity bits of sets of over some 1,000 elements are as good as random; counts tell such sets apart
    up to some 8,000. They are compared only where parity allows the similarity.
    """
    words = SLICES // 64

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = a[..., 0].astype(np.int64), b[..., 0].astype(np.int64)
        most = (x + y) * (1 - similarity) / (1 + similarity) + 1e-6
        odd = sum(np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.int64) for k in range(1, 1 + words))
        hit = (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6) & (odd <= most)
        wide = (*hit.shape, a.shape[-1])
        a, b = np.broadcast_to(a, wide), np.broadcast_to(b, wide)
        at = np.nonzero(hit)
        for i in range(0, len(at[0]), PAIRS_REFINED):
            part = tuple(x[i : i + PAIRS_REFINED] for x in at)
            hit[part] = apart_by_counts(a[part][:, 1:], b[part][:, 1:]) <= most[part]
        return hit

    return near


def may_be_alike(similarity: float, least_shared: int) -> Near:
    """Which of (size, positional bytes, parity bits) share ``least_shared`` bytes and can have that Jaccard similarity.

    Elements in one of two sets only are at least as many as the parity bits that
    differ, so sizes and parity rule out no pair that has the similarity.
    """

    def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = a[..., 0].astype(np.int64), b[..., 0].astype(np.int64)
        marks = range(1, 1 + len(MARK))
        shared = sum((((a[..., k] ^ b[..., k]) >> U(8 * byte)) & U(255) == 0).astype(np.uint8) for k in marks for byte in range(8)) if least_shared else 0
        apart = sum(np.bitwise_count(a[..., k] ^ b[..., k]).astype(np.int64) for k in range(1 + len(MARK), a.shape[-1]))
        sized = np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6
        return sized & (shared >= least_shared) & (apart <= (x + y) * (1 - similarity) / (1 + similarity) + 1e-6)

    return near


def _list_partners(marks: np.ndarray, roots: np.ndarray, partners: int, near: Near) -> tuple[list[np.ndarray], list[np.ndarray], bool]:
    """For each member of one list its first ``partners`` near members of other roots, and whether any has more."""
    left, right, more = [], [], False
    if (roots == roots[0]).all():
        return left, right, more
    for i in range(0, len(marks), 512):
        rows = np.arange(i, min(i + 512, len(marks)))
        taken = np.zeros(len(rows), np.int64)
        for j in range(0, int(rows[-1]) + 1, BLOCK):
            others = np.arange(j, min(j + BLOCK, int(rows[-1]) + 1))
            hit = near(marks[rows][:, None], marks[others][None, :]) & (roots[rows][:, None] != roots[others][None, :]) & (others[None, :] < rows[:, None])
            r, o = np.nonzero(hit)
            count = np.bincount(r, minlength=len(rows))
            place = np.arange(len(r)) - (np.cumsum(count) - count)[r] + taken[r]
            left.append(others[o[place < partners]])
            right.append(rows[r[place < partners]])
            taken += count
            more |= bool((taken > partners).any())
            rows, taken = rows[taken <= partners], taken[taken <= partners]
            if not len(rows):
                break
    return left, right, more


def candidate_pairs(partners: int, near: Near) -> Callable[..., pa.RecordBatch]:
    """Pairs (a, b) within posting lists that are ``near`` and not yet known to be connected.

    A short list gives all of them. In a longer one every member is given its
    first ``partners``; a list in which a member has more of them is given
    back, as rows (a, b null, key, size, ...), for another round. ``near`` is given
    the size and the columns after root along the last axis.
    """

    def links(keys: np.ndarray, size: np.ndarray, ids: np.ndarray, roots: np.ndarray, *sketch: np.ndarray) -> pa.RecordBatch:
        marks = np.stack([size, *sketch], axis=1).view(U)
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        members = np.diff(cut)
        short = np.repeat(members <= SHORT_LIST, members)
        left, right, again = [], [], []
        for d in range(1, int(members[members <= SHORT_LIST].max(initial=1))):
            i = np.flatnonzero((keys[d:] == keys[:-d]) & (roots[d:] != roots[:-d]) & short[d:])
            i = i[near(marks[i], marks[i + d])]
            left.append(i)
            right.append(i + d)
        for g in np.flatnonzero(members > SHORT_LIST):
            a, b, more = _list_partners(marks[cut[g] : cut[g + 1]], roots[cut[g] : cut[g + 1]], partners, near)
            left += [x + cut[g] for x in a]
            right += [x + cut[g] for x in b]
            if more:
                again.append(np.arange(cut[g], cut[g + 1]))
        a, b, rest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, again))
        a, b = ids[a], ids[b]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1)[a != b], axis=0)
        none = pa.nulls(len(pairs), pa.int64())
        columns = [(pairs[:, 0], ids[rest]), (pairs[:, 1], None), (None, keys[rest]), *[(None, x[rest]) for x in (size, *sketch)]]
        gone = pa.nulls(len(rest), pa.int64())
        made = [pa.concat_arrays([none if x is None else pa.array(x.copy()), gone if y is None else pa.array(y)]) for x, y in columns]
        return pa.RecordBatch.from_arrays(made, names=["a", "b", "key", "size", *[f"x{k}" for k in range(len(sketch))]])

    return links


def splittable(state: np.ndarray) -> np.ndarray:
    """Which lists may be split: the state holds the group of the key, the first part of FURTHER not yet passed, and the splits so far."""
    return (state >= 0) & (state >> 8 < SPLITS) & (state >> 4 & 15 < FURTHER.shape[1])


def split_lists(keys: np.ndarray, state: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, key and state of every posting of the rows under SPLIT further positional bytes.

    Parts are taken in rising order, so a pair is posted once under each set of parts that it shares.
    """
    data, group, begin, splits = marks.view(np.uint8).reshape(len(keys), POSITIONS), state & 15, state >> 4 & 15, state >> 8
    rows, out, states = [], [], []
    for part in range(FURTHER.shape[1]):
        on = np.flatnonzero(begin <= part)
        own = data[on[:, None], FURTHER[group[on], part]].astype(U)
        content = sum(own[:, k] << U(8 * k) for k in range(SPLIT)) | U((part + 1) << 56)
        rows.append(on)
        out.append(mix(keys[on].view(U) ^ mix(content)).view(np.int64))
        states.append(group[on] | part + 1 << 4 | splits[on] + 1 << 8)
    return np.concatenate(rows), np.concatenate(out), np.concatenate(states)


def _split_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, state, node, root, MARK) in, (key, state, node, root) of the split lists out."""
    for batch in batches:
        keys, state, node, root, *marks = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        rows, key, states = split_lists(keys, state, np.ascontiguousarray(np.stack(marks, axis=1)))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, states, node[rows], root[rows])], names=["key", "state", "node", "root"])


Rows = list[np.ndarray]


def streamed_lists(links: Callable[..., pa.RecordBatch], passing: Callable[[Rows], pa.RecordBatch], may_pass: Callable[[Rows], bool], most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run ``links`` over whole lists of rows sorted by their first column.

    A list of over ``most`` rows that ``may_pass`` allows is never held: its rows go to ``passing`` as they come.
    """
    held: list[Rows] = []
    passes = False  # the list of the key in hand

    def settle(rows: Rows) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate([[True], rows[0][1:] != rows[0][:-1], [True]]))
        long = [(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True) if b - a > most and may_pass([x[a : a + 1] for x in rows])]
        whole = np.ones(len(rows[0]), bool)
        for a, b in long:
            whole[a:b] = False
            yield passing([x[a:b] for x in rows])
        if whole.any():
            yield links(*[x[whole] for x in rows])

    key = None
    for batch in batches:
        fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if len(fresh[0]):
            own = 0 if key is None else int(np.searchsorted(fresh[0], key, side="right"))
            if own and passes:
                yield passing([x[:own] for x in fresh])
            elif own:
                held.append([x[:own] for x in fresh])
            if own < len(fresh[0]):  # the list in hand ends here
                if held:
                    yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])
                last = max(own, int(np.searchsorted(fresh[0], fresh[0][-1])))
                if last > own:
                    yield from settle([x[own:last] for x in fresh])
                key, passes, held = fresh[0][-1], False, [[x[last:] for x in fresh]]
            if not passes and sum(len(x[0]) for x in held) > most and may_pass(held[0]):
                passes = True
                yield passing([np.concatenate(x) for x in zip(*held, strict=True)])
                held = []
    if held:
        yield from settle([np.concatenate(x) for x in zip(*held, strict=True)])


def met_lists(partners: int, near: Near, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``candidate_pairs`` of rows (key, state, size, node, root, SKETCH) sorted by key; rows of lists to be split come back as (node, null, key, state)."""
    links = candidate_pairs(partners, near)
    anchors: dict[int, Rows] = {}

    def whole(keys: np.ndarray, state: np.ndarray, *rest: np.ndarray) -> pa.RecordBatch:
        made = links(keys, *rest)
        kept = pa.array(np.full(made.num_rows, -1), mask=made.column(2).is_null().to_numpy(zero_copy_only=False))
        return made.append_column("state", kept)

    def passing(rows: Rows) -> pa.RecordBatch:
        if int(rows[0][0]) not in anchors:
            anchors.clear()
            anchors[int(rows[0][0])] = [x[:ANCHORS] for x in rows]
        first, pairs = anchors[int(rows[0][0])], []
        for i in range(0, len(rows[0]), most):
            _, _, size, ids, roots, *sketch = (np.concatenate([x, y[i : i + most]]) for x, y in zip(first, rows, strict=True))
            left, right, _ = _list_partners(np.stack([size, *sketch], axis=1).view(U), roots, PARTNERS, near)
            pairs += [np.stack([ids[a], ids[b]], axis=1) for a, b in zip(left, right, strict=True)]
        met = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        met = np.unique(np.sort(met, axis=1), axis=0)
        gone, none = pa.nulls(len(met), pa.int64()), pa.nulls(len(rows[0]), pa.int64())
        a = pa.concat_arrays([pa.array(met[:, 0].copy()), pa.array(rows[3])])
        b, key, state = (pa.concat_arrays(x) for x in ([pa.array(met[:, 1].copy()), none], [gone, pa.array(rows[0])], [gone, pa.array(rows[1])]))
        empty = pa.concat_arrays([gone, none])
        names = ["a", "b", "key", "size", *[f"x{k}" for k in range(len(rows) - 5)], "state"]
        return pa.RecordBatch.from_arrays([a, b, key, *[empty] * (len(rows) - 4), state], names=names)

    return streamed_lists(whole, passing, lambda rows: bool(splittable(rows[1][:1])[0]), most, batches)


def lists_apart(keys: np.ndarray, state: np.ndarray, ids: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
    """The rows of posting lists in which several groups meet."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    several = np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)
    on = np.repeat(several, np.diff(np.append(first, len(keys))))
    return pa.RecordBatch.from_arrays([pa.array(x[on]) for x in (keys, state, ids, roots)], names=["key", "state", "node", "root"])


def _apart_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lists_apart``; lists that are too long to wait for their groups pass."""
    names = ["key", "state", "node", "root"]
    return streamed_lists(lists_apart, lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=names), lambda rows: True, 64 * LONG_LIST, batches)


def _lists_task(partners: int, near: Near, most: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return met_lists(partners, near, most, batches)

    return tidy(task)


def _sets_task(words: int):
    """(id, text) in, (id, grams) out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shingle_sets(batch.column(1), words), pa.list_(pa.int64()))], names=["id", "grams"])

    return tidy(task)


def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose second column, the text, is compressed: less to shuffle than Spark's own block compression leaves."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in portions(batches, 1):
        data, at = utf8(batch.column(1))
        raw = memoryview(data)
        packed = pa.array([squeeze.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), packed, *batch.columns[2:]], names=batch.schema.names)


def _alike_task(words: int, similarity: float):
    """(a, b, compressed texts) in, (a, b) of those whose sets of shingles have that Jaccard similarity out."""

    def sets(column: pa.Array, expand: zstandard.ZstdDecompressor) -> list[np.ndarray]:
        return shingle_sets(pa.array([expand.decompress(x.as_buffer()) for x in column], pa.binary()), words)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, PAIRS_AT_ONCE):
                part = batch.slice(i, PAIRS_AT_ONCE)
                both = list(zip(sets(part.column(2), expand), sets(part.column(3), expand), strict=True))
                same = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in both]
                every = [len(x) + len(y) - n for (x, y), n in zip(both, same, strict=True)]
                alike = pa.array([n > 0 and m >= similarity * n for m, n in zip(same, every, strict=True)], pa.bool_())
                yield part.select([0, 1]).filter(alike)

    return tidy(task)


def _marks_task(words: int):
    """(doc_id, text, hash, hash_2) in; size, positional bytes and counts instead of the text out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            sets = shingle_sets(batch.column(1), words)
            bits = np.array([counts(x) for x in sets], np.int64).reshape(-1, len(COUNTS))
            marks = np.concatenate([positional_bytes(sets), bits], axis=1)
            made = [pa.array([len(x) for x in sets], pa.int64()), *[pa.array(marks[:, k].copy()) for k in range(len(MARK) + len(COUNTS))]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *made], names=["doc_id", "hash", "hash_2", "size", *MARK, *COUNTS])

    return tidy(task)


def _heads_task(words: int, similarity: float, shared):
    """(doc_id, text, hash, hash_2) in; the prefix instead of the text out."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            heads = pa.array([prefix(x, similarity, *shared.value) for x in shingle_sets(batch.column(1), words)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), heads], names=["doc_id", "hash", "hash_2", "head"])

    return tidy(task)


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles found in several of some ORDER_TEXTS texts, sorted by hash, and their place by frequency."""
    share = min(1.0, ORDER_TEXTS / max(1, rows.count()))
    some = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select(F.lit(0).cast("long").alias("id"), "text")
    grams = some.mapInArrow(_sets_task(words), "id long, grams array<long>").select(F.explode("grams").alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "gram").limit(ORDER_MOST)
    common = np.array([r.gram for r in often.collect()], np.int64)  # most frequent first; at most ORDER_MOST
    order = np.argsort(common)
    return common[order], -order


def _alike(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) whose sets of shingles have a Jaccard similarity of ``similarity`` at least."""
    both = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(_alike_task(words, similarity), "a long, b long")


def _links(
    posted: DataFrame, lists_of: Callable[[DataFrame], DataFrame], near: Near, texts_of: Callable[[DataFrame], DataFrame], words: int, similarity: float, links: DataFrame | None, roots: DataFrame | None, sketch: Sequence[str] = tuple(SKETCH)
) -> tuple[DataFrame, DataFrame]:
    """(a, b) of ``links`` and of all links between texts ``posted`` (key, state, node, root) in one list; and (node, root). ``near`` is given the size and ``sketch``."""
    longs = ", ".join(f"x{k} long" for k in range(len(sketch)))
    names = [f"x{k}" for k in range(len(sketch))]
    columns = ["key", "state", "size", "node", "root", *names]

    def with_sketch(posted: DataFrame) -> DataFrame:
        return lists_of(posted).select("key", "state", "size", "node", "root", *[F.col(s).alias(f"x{k}") for k, s in enumerate(sketch)])

    lists = with_sketch(posted)
    held = tried = None
    partners = PARTNERS
    while True:
        # One order in all lists: two texts that meet in many of them make the same pair.
        dealt = lists.repartition("key").sortWithinPartitions("key", "node")
        met = write_table(dealt.mapInArrow(_lists_task(partners, near, LONG_LIST), f"a long, b long, key long, size long, {longs}, state long"), "like-lists")
        pairs = met.filter(F.col("key").isNull()).select("a", "b").distinct()
        pairs = write_table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "like-pairs")
        if held is None:
            held = write_table(texts_of(met.select(F.explode(F.array("a", "b")).alias("node")).filter(F.col("node").isNotNull()).distinct()), "like-held")
        fresh = write_table(_alike(pairs, held, words, similarity), "like-links")
        if roots is None or not fresh.isEmpty():
            links = fresh if links is None else links.unionByName(fresh)
            roots = components(links)
        open_lists = met.filter(F.col("key").isNotNull()).withColumnRenamed("a", "node").drop("b")
        if open_lists.isEmpty():
            return links, roots
        rooted = open_lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*columns)
        long_lists = rooted.filter(F.col("size").isNull()).select("key", "state", "node", "root")
        lists = rooted.filter(F.col("size").isNotNull())
        if not open_lists.filter(F.col("size").isNull()).isEmpty():
            # Lists that copies have joined by now go before the others are posted again.
            again = lists_of(long_lists).select("key", "state", "node", "root", *MARK)
            lists = lists.unionByName(with_sketch(again.mapInArrow(tidy(_split_task), "key long, state long, node long, root long")))
        tried = pairs if tried is None else tried.unionByName(pairs)
        partners *= MORE_PARTNERS


def grouped_texts(docs: DataFrame, words: int, similarity: float, exact: bool) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` with a doc_id as (doc_id, hash, hash_2), and every distinct text as (hash, hash_2, doc_id, group)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("hash_2"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, hash long, hash_2 long, size long, {', '.join(f'{s} long' for s in (*MARK, *COUNTS))}"
    marked = write_table(rows.mapInArrow(_marks_task(words), schema), "like-marks")
    first = marked.groupBy("hash", "hash_2").agg(F.min(F.struct("doc_id", "size", *MARK, *COUNTS)).alias("row"))
    # Written, so that the numbers stay: a node is a text, whatever ids its rows have.
    texts = write_table(first.select("hash", "hash_2", "row.*").withColumn("node", F.monotonically_increasing_id()), "like-texts")
    ids = texts.select("doc_id", "hash", "hash_2", "node")

    def texts_of(nodes: DataFrame) -> DataFrame:
        # Merge joins at every size: what is asked for grows with the corpus and is not to be broadcast.
        wanted = ids.hint("merge").join(nodes, "node", "left_semi")
        packed = rows.mapInArrow(tidy(packed_texts), f"doc_id {kind}, text binary, hash long, hash_2 long")
        return packed.hint("merge").join(wanted, ["doc_id", "hash", "hash_2"]).select("node", "text").dropDuplicates(["node"])

    keys = [((F.shiftrightunsigned(m, 32) if half else F.col(m).bitwiseAND(F.lit(0xFFFFFFFF))) + F.lit((2 * i + half) << 32)) for i, m in enumerate(MARK) for half in (0, 1)]
    group = F.shiftrightunsigned("key", 32).alias("state")
    posted = texts.filter("size > 0").select(F.explode(F.array(*keys)).alias("key"), "node", F.col("node").alias("root")).select("key", group, "node", "root")

    def lists_of(posted: DataFrame) -> DataFrame:
        met = posted.repartition("key").sortWithinPartitions("key", "node").mapInArrow(tidy(_apart_task), "key long, state long, node long, root long")
        return met.hint("merge").join(texts.select("node", "size", *MARK, *COUNTS), "node")

    links, roots = _links(posted, lists_of, may_be_alike(similarity, LEAST_SHARED), texts_of, words, similarity, None, None)
    if exact:
        shared = rows.sparkSession.sparkContext.broadcast(common_shingles(rows, words))
        headed = rows.mapInArrow(_heads_task(words, similarity, shared), f"doc_id {kind}, hash long, hash_2 long, head array<long>")
        grouped = ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        met = headed.hint("merge").join(grouped, ["doc_id", "hash", "hash_2"])
        heads = met.select(F.explode("head").alias("key"), F.lit(-1).cast("long").alias("state"), "node", "root")
        _, roots = _links(heads, lists_of, counts_allow(similarity), texts_of, words, similarity, links, roots, COUNTS)
    return marked.select("doc_id", "hash", "hash_2"), ids.join(roots, "node", "left").select("hash", "hash_2", "doc_id", F.coalesce("root", "node").alias("group"))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, exact: bool = True) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs`` with a doc_id: groups of texts alike in ``words``-word shingles.

    Equal texts meet first, as one. ``component_id`` is the smallest doc_id of the
    group; rows that repeat a doc_id with other texts belong to their texts' groups.
    Texts without words (null ones are empty) are alike only if equal. Without
    ``exact`` some pairs near the bound may be missed. An empty table gives an
    empty result.
    """
    rows, texts = grouped_texts(docs, words, similarity, exact)
    named = texts.join(texts.groupBy("group").agg(F.min("doc_id").alias("component_id")), "group")
    return rows.join(named.select("hash", "hash_2", "component_id"), ["hash", "hash_2"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8, exact: bool = False) -> DataFrame:
    """One row of ``docs`` for each group of similar documents, all columns: that of the smallest doc_id.

    Where rows of a group repeat that doc_id, the one whose text has the smallest
    hash is kept, and one of those equal in both. Rows without a doc_id are kept.
    """
    _, texts = grouped_texts(docs, words, similarity, exact)
    first = texts.groupBy("group").agg(F.min(F.struct("doc_id", "hash", "hash_2")).alias("row"))
    kept = write_table(first.select(F.col("row.doc_id").alias("_id"), F.col("row.hash").alias("_hash"), F.col("row.hash_2").alias("_hash_2")), "like-first")
    text = F.coalesce(docs["text"], F.lit(""))
    found = docs.hint("merge").join(kept, (docs["doc_id"] == kept["_id"]) & (F.xxhash64(text) == kept["_hash"]) & (F.xxhash64(F.lit(1), text) == kept["_hash_2"]), "left_semi")
    ids = docs.filter(F.col("doc_id").isNotNull()).agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.rows != ids.ids:  # repeated rows
        found = found.dropDuplicates(["doc_id", "text"])
    return found.unionByName(docs.filter(F.col("doc_id").isNull()))
