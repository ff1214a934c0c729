from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.llm import repeats
from tarn.llm.suffixsort import Block


def brute(texts, length):
    """(removed bytes, spans, kept) per text, in the given order."""
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            if raw[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(raw[p : p + length])
        spans = sum(1 for j in range(len(raw)) if gone[j] and not (j and gone[j - 1]))
        out.append((sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=30), st.integers(0, 3)), min_size=1, max_size=8), st.sampled_from([b"ab", b"\x00a", b"abcdef"]), st.randoms(use_true_random=False))
def test_suffix_array_is_sorted_and_repeats_are_exact(parts, alphabet, rng):
    length = 16
    base = bytes(rng.choice(alphabet) for _ in range(40))
    strings = [base[: rng.randint(0, 40)] + bytes(rng.choice(alphabet) for _ in range(len(p) + length)) for p, _ in parts]
    windows = np.array([len(s) - length + 1 for s in strings])
    document, start = np.array([d for _, d in parts]), np.arange(len(parts)) * 1000
    block = Block(np.frombuffer(b"".join(strings), np.uint8), windows, length)
    order = [i for i in block.suffix_array() if block.is_window[i]]
    text = block.text.tobytes()
    read = [text[block.at[i] : block.at[i] + length] for i in order]
    assert read == sorted(read) and len(order) == windows.sum()
    flags = block.repeats(document, start)
    first = {}
    for s in sorted(range(len(strings)), key=lambda s: (document[s], start[s])):
        for j in range(windows[s]):
            first.setdefault(strings[s][j : j + length], (s, j))
    for i in order:
        s, j = block.owner[i], block.offset[i]
        assert flags[i] == (first[strings[s][j : j + length]] != (s, j))


def check(spark, rows, length=100, gram=20, **patched):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {(r.doc_id, bytes(r.kept)): (r.n_removed, len(r.spans), r.n_bytes) for r in repeats.remove_repeats(df, length, gram).collect()}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[1] is not None))
    assert sum(1 for _ in found) <= len(rows)
    for (doc_id, text), (gone, spans, kept) in zip(ordered, brute([t for _, t in ordered], length), strict=True):
        assert found[doc_id, kept] == (gone, spans, len((text or "").encode())), doc_id


def test_texts_equal_brute_force(spark, unique_docs):
    check(spark, [(r.doc_id, r.text) for r in unique_docs.collect()])


def test_repeated_and_missing_ids(spark, rows):
    check(spark, [(r[0], r[1]) for r in rows] + [(None, rows[70][1]), (None, "short")])


def test_heavy_passages_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY_LEAST", 3)
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = word(300)
    check(spark, [(i, word(rng.randint(0, 150)) + passage + word(rng.randint(0, 150))) for i in range(40)])


def test_small_slices_and_runs(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SLICE", 257)
    monkeypatch.setattr(repeats, "LONGEST_RUN", 7)
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 64)
    data = np.frombuffer(("ab" * 400 + "xyz" * 300).encode(), np.uint8)
    owner, row, start, count, _ = repeats.window_runs(data, np.array([0, 500, 500, len(data)]), 100, 20)
    covered = sorted((r, s + j) for r, s, n in zip(row, start, count, strict=True) for j in range(n))
    assert covered == [(0, i) for i in range(401)] + [(2, i) for i in range(len(data) - 500 - 99)]


def test_empty_table_other_columns_and_bad_parameters(spark, no_docs, unique_docs):
    assert repeats.remove_repeats(no_docs).count() == 0
    clashing = unique_docs.withColumn("key", F.lit(0)).withColumn("packed", F.lit("x")).withColumn("spans", F.lit(1))
    assert repeats.remove_repeats(clashing).count() == unique_docs.count()
    with pytest.raises(ValueError):
        repeats.remove_repeats(no_docs, length=8)


def test_cut_keeps_rows_and_whole_characters(spark):
    text = "é" * 80
    df = spark.createDataFrame([(1, text, 80), (2, "a" + text + "b", 82), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r.text for r in repeats.cut_repeats(df).collect()}
    # The first text repeats itself from its second character on.
    assert set(out) == {1, 2, 3, 4} and out[3] is None and out[4] == "" and "�" not in "".join(x or "" for x in out.values())


def test_cut_passes_clashing_columns_through(spark):
    passage = "p" * 60 + "q" * 60
    rows = [(1, passage, 120), (2, "x " + passage, 122), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumns({n: F.lit("k") for n in ("text_is_null", "_cut", "cut", "rest", "carried", "key", "own", "c0", "_text")})
    out = {r.doc_id: r for r in repeats.cut_repeats(df).collect()}
    assert out[1].text == passage and out[2].text == "x " and out[2].n_chars == 2 and out[3].text is None
    assert all(r[n] == "k" for r in out.values() for n in ("text_is_null", "_cut", "rest", "own", "c0"))


@pytest.mark.parametrize("rows_a_batch", [1, 7, 10_000])
def test_blocks_end_between_values_and_hold_one_value_too_many_at_most(rows_a_batch):
    rng = random.Random(4)
    dealt = sorted(rng.randint(0, 400) for _ in range(3000))
    value = [rng.choice([None, b"", b"x" * rng.randint(1, 300)]) for _ in dealt]
    table = pa.table({"dealt": dealt, "key": dealt, "start": dealt, "windows": dealt, "value": pa.array(value, pa.binary())})
    blocks = list(repeats.dealt_blocks(iter(table.to_batches(max_chunksize=rows_a_batch)), 4000))
    assert pa.concat_tables(blocks).equals(table)
    held = [set(b["dealt"].to_pylist()) for b in blocks]
    assert len(blocks) > 50 and sum(map(len, held)) == len(set(dealt))
    for b in blocks:
        last = b["dealt"][-1].as_py()
        assert sum(repeats.ROW_BYTES + len(v or b"") for d, v in zip(b["dealt"].to_pylist(), b["value"].to_pylist(), strict=True) if d != last) < 4000


def test_sorting_holds_little_of_a_large_batch():
    """The arrays of blocks, as traced: a batch of 10,000 strings is not one block."""
    rng = np.random.default_rng(3)
    n, windows = 10_000, 150
    value = [x.tobytes() for x in rng.integers(97, 123, (n, windows + 99), dtype=np.uint8)]
    column = lambda x: pa.array(x, pa.int64())
    batch = pa.RecordBatch.from_arrays([column(range(n)), column(range(n)), column([0] * n), column([windows] * n), pa.array(value, pa.binary())], names=["dealt", "key", "start", "windows", "value"])
    tracemalloc.start()
    rows = sum(b.num_rows for b in repeats._sorting_task(100)(iter([batch])))
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert rows == 0 and most < 60e6
