from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import histogramsort, packing
from tarn.llm.catalogue import tokenizer_path


def expected_shards(rows, shards):
    keyed = sorted((int(hashlib.md5((t or "").encode()).hexdigest()[:15], 16), i, len((t or "").encode()) + 16) for i, t in rows)
    total, below, out, slots = sum(k[2] for k in keyed), 0, {}, {}
    for _, i, size in keyed:
        shard = below * shards // total
        out[i] = (size, shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        below += size
    return out


@pytest.mark.parametrize("run_rows", [200_000, 3])
def test_shards_equal_brute_force(unique_docs, run_rows):
    clashing = unique_docs.withColumns({n: F.lit("x") for n in ("_size", "_before", "_place", "_of", "_run", "_k0")}).withColumn("_shard", F.lit(9))
    found = histogramsort.shard_documents(clashing, shards=7, run_rows=run_rows).collect()
    wanted = expected_shards([(r.doc_id, r.text) for r in found], 7)
    assert {r.doc_id: (r._size, r._shard) for r in found} == {i: w[:2] for i, w in wanted.items()}
    for shard in range(7):
        slots = sorted(r._slot for r in found if r._shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.doc_id: r._slot for r in found} == {i: w[2] for i, w in wanted.items()}
    assert all(r._crc == zlib.crc32((r.text or "").encode()) for r in found)


def test_one_text_with_most_rows_is_cut_between_copies(spark):
    df = spark.createDataFrame([(i, "same text") for i in range(3000)] + [(9000 + i, f"other {i}") for i in range(50)], "doc_id long, text string")
    counts = {r._shard: r["count"] for r in histogramsort.shard_documents(df, shards=10).groupBy("_shard").count().collect()}
    assert len(counts) == 10 and max(counts.values()) - min(counts.values()) <= 6


def test_slots_follow_the_key_where_a_text_is_cut_into_runs(spark):
    rows = [(7 * i % 3001, "same text") for i in range(3001)] + [(9000 + i, f"other {i}") for i in range(150)] + [(5000 + i, "second text") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = histogramsort.shard_documents(df, shards=3, run_rows=100).collect()
    wanted = expected_shards(rows, 3)
    assert {r.doc_id: (r._size, r._shard, r._slot) for r in found} == wanted


def test_tolerance_repeated_rows_and_empty(docs, no_docs):
    assert histogramsort.shard_documents(no_docs).count() == 0
    assert histogramsort.shard_documents(docs, shards=5, tolerance=4000).count() == docs.count()


def tokens(text):
    return packing._tokenizer(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


AWKWARD = "can't.x re've-y a.b,c!D 's foo<|ENDOFTEXT|> e.́x ,́y #a$b%c&d*e(f)g <|endoftext|>,foo.<|startoftext|>bar ﬁ ½ İ ΣΑΣ 漢字 🙂👍🏽 \x1c\x85 x"


def test_pieces_and_sequences(spark, docs, rows):
    df = docs.unionByName(spark.createDataFrame([(500, AWKWARD, None, None, 1)], docs.schema)).withColumn("piece", F.lit("x"))
    found = packing.pack_documents(df, tokenizer_path(), capacity=64, keep_ids=True).collect()
    by_doc = {}
    for r in sorted(found, key=lambda r: (r.doc_id, r.piece)):
        by_doc.setdefault(r.doc_id, []).append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length <= 64 and zlib.crc32(r.ids) == r.ids_crc32 and r.start == 64 * r.piece
    texts = {r[0]: r[1] for r in rows} | {500: AWKWARD}
    repeated = rows[3][0]
    for i, text in texts.items():
        if i != repeated:
            assert [int(x) for r in by_doc[i] for x in np.frombuffer(r.ids, "<u4")] == tokens(text)
    sequences = {}
    for r in found:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences) <= 1.15 * -(-sum(r.length for r in found) // 64)


def test_many_groups_are_packed_twice(spark, docs, monkeypatch):
    pieces = packing.tokenised(docs, tokenizer_path(), 64).persist()
    few = packing.pack(pieces, 64).select("sequence_id").distinct().count()
    many = packing.pack(pieces, 64, group_rows=40)
    assert many.count() == pieces.count()
    fill = [r.n for r in many.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert max(fill) <= 64 and len(fill) <= few + 12


def test_rule_places_where_squares_grow_least():
    where, offset = packing.sum_of_squares(np.array([6, 6, 4, 4]), 10)
    assert where.max() == 1 and sorted(zip(where, offset, strict=True)) == [(0, 0), (0, 6), (1, 0), (1, 6)]
    where, _ = packing.sum_of_squares(np.array([10, 10]), 10)
    assert list(where) == [0, 1]
    assert len(packing.sum_of_squares(np.zeros(0, np.int64), 10)[0]) == 0


def test_known_units_drop_the_older_generation(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_UNITS", 3)
    known = packing.KnownUnits(tokenizer_path())
    for text in ("a b c d e", "a x y z", "b q"):
        words = sorted(text.split())
        key = np.array([ord(w) for w in words], np.uint64)
        flat, start, size = known(key, key + np.uint64(1), lambda at, words=words: [words[i] for i in at])
        assert [flat[a : a + n].tolist() for a, n in zip(start, size, strict=True)] == [tokens(w)[:-1] for w in words]
    # Another unit with the key of "b" is not taken for it.
    flat, start, size = known(np.array([ord("b")], np.uint64), np.array([7], np.uint64), lambda at: ["zebra"])
    assert flat[start[0] : start[0] + size[0]].tolist() == tokens("zebra")[:-1]


def test_empty_table(no_docs):
    assert packing.pack_documents(no_docs, tokenizer_path()).count() == 0
