from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from tarn.llm import simhash


def fingerprint(text, k=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    parts = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(pairs):
    """Smallest reachable id per row for (id, fingerprint) rows."""
    ids = np.array([i for i, _ in pairs])
    fps = np.array([f for _, f in pairs], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    label = ids.copy()
    while True:
        new = np.array([label[near[i]].min() for i in range(len(ids))])
        if (new == label).all():
            return label
        label = new


def test_fingerprints_equal_brute_force(rows):
    texts = [r[1] for r in rows] + ["Straße ÄÖ A\x0bB\x0cC", "w " * 3 + "q" * 700 + " z", "一 二 三 四"]
    assert [int(x) for x in simhash.fingerprints(pa.array(texts))] == [fingerprint(t) for t in texts]


def test_components_equal_brute_force(spark, docs, rows):
    clashing = docs.withColumn("fp", F.lit("x")).withColumn("rep", F.lit(1)).withColumn("component_id", F.lit(None))
    found = [(r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(clashing).collect()]
    wanted = [(r[0], fingerprint(r[1])) for r in rows]
    assert sorted(x[:2] for x in found) == sorted(wanted)
    assert sorted(found) == sorted((i, f, int(c)) for (i, f), c in zip(wanted, brute(wanted), strict=True))


def test_links_within_two_bits_survive_large_lists(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = np.concatenate([base, base ^ np.uint64(3), base ^ np.uint64(1 << 63), np.uint64(7) ^ (np.uint64(1) << np.arange(60, dtype=np.uint64))])
    fps = np.unique(near)
    keys = np.zeros(len(fps), np.int64)
    a, b = simhash.link_lists(keys, fps)
    label = {int(f): int(f) for f in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label[max(root(x), root(y))] = min(root(x), root(y))
    index = brute([(i, int(f)) for i, f in enumerate(fps)])
    ours = np.array([root(int(f)) for f in fps])
    assert len(set(ours)) == len(set(index))
    assert len({(x, y) for x, y in zip(ours, index, strict=True)}) == len(set(index))


def test_lists_may_span_batches():
    fps = np.array([8, 9, 11, 1 << 40, (1 << 40) + 1], np.uint64)
    keys = np.array([1, 1, 1, 2, 2])
    batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + 1]) for x in (keys, keys * 0, fps.view(np.int64))], names=["key", "choice", "fp"]) for i in range(5)]
    links = [tuple(r.values()) for b in simhash._tally_task(iter(batches)) for r in b.to_pylist()]
    assert len(links) == 3


def test_long_lists_are_split_and_lose_no_link(monkeypatch):
    monkeypatch.setattr(simhash, "LONG_LIST", 6)
    rng = np.random.default_rng(4)
    base = np.uint64(0x1122334455667788)
    fps = [base ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in rng.integers(32, 64, (60, 2))] + [base ^ np.uint64(x) for x in (3 << 40, 7 << 50, 15 << 33)]
    fps += [np.uint64(x) for x in (5, 4, 9 << 60)]
    fps = np.unique(np.array(fps, np.uint64))
    postings = []
    for choice, positions in enumerate(simhash.KEYS):
        mask = np.uint64(sum(255 << (8 * p) for p in positions))
        postings += [(hash((int(f & mask), choice)) >> 1, choice, int(f.view(np.int64))) for f in fps]
    postings.sort()
    columns = [np.array(c, np.int64) for c in zip(*postings, strict=True)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 5]) for c in columns], names=["key", "choice", "fp"]) for i in range(0, len(postings), 5)]
    met = [r for b in simhash._tally_task(iter(batches)) for r in b.to_pylist()]
    again = sorted((r["key"], r["left"], r["a"]) for r in met if r["key"] is not None)
    assert again and all(n <= 65536 for n in (len(again),))
    split = pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*again, strict=True)], names=["key", "left", "fp"])
    links = [(r["a"], r["b"]) for r in met if r["b"] is not None] + [(r["a"], r["b"]) for b in simhash._split_task(iter([split])) for r in b.to_pylist()]
    at = {int(f.view(np.int64)): i for i, f in enumerate(fps)}
    root = simhash._forest(np.array([at[a] for a, _ in links]), np.array([at[b] for _, b in links]), len(fps))
    assert root.tolist() == brute([(i, int(f)) for i, f in enumerate(fps)]).tolist()


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
