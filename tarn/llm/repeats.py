"""Removal of repeated byte strings across documents by a distributed suffix array.

Every window of ``length`` bytes belongs to the smallest hashed k-gram inside it,
so equal windows belong to equal k-grams. Runs of neighbouring windows with one
k-gram are the unit of work: a run whose k-gram occurs nowhere else holds no
repeat and is left at once; the others travel, as short strings, to the task of
their k-gram, where two-stage suffix sorting (``suffixsort``) finds windows that
stand earlier too.

Hot passages: equal strings are merged before they travel, k-grams that occur
often in one batch send one representative to the counting shuffle, and runs of
the few k-grams above ``HEAVY_SHARE`` of all runs are split into windows dealt by
their whole content. No task receives all rows of a frequent passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tarn.llm.buffers import chunks, portions, runs, tidy, utf8
from tarn.llm.scratch import write_table
from tarn.llm.suffixsort import Block

LENGTH = 100
GRAM = 20
SLICE = 1 << 20
CHUNK_BYTES = 4 << 20
LONGEST_RUN = 512
BLOCK_BYTES = 1 << 19  # of rows sorted together; meanwhile a worker takes some 100 times as much
ROW_BYTES = 32  # of a row in a block beside its string
# A k-gram with more than this share of the candidate runs is heavy; at most 1/share can be.
HEAVY_SHARE = 1 / 1000
HEAVY_LEAST = 20_000

U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _table() -> np.ndarray:
    """A 64-bit value per byte, from the multiply-xorshift rule."""
    x = np.arange(1, 257, dtype=U) * U(_BASE)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE = _table()


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes from every position, by doubling."""
    whole, done, part, span = None, 0, BYTE[data], 1
    while True:
        if size & span:
            if whole is None:
                whole = part
            else:
                n = min(len(whole), len(part) - done)
                whole = whole[:n] * U(pow(_BASE, span, 2**64)) + part[done : done + n]
            done += span
        if 2 * span > size:
            break
        part = part[:-span] * U(pow(_BASE, span, 2**64)) + part[span:]
        span *= 2
    whole = (whole ^ (whole >> U(32))) * U(0xD6E8FEB86659FD93)
    return whole ^ (whole >> U(29))


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` over every ``width`` neighbours, by doubling."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[:-rest], values[rest:]) if rest else values


def owners(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window start the smallest k-gram hash in the window; hashes that own twice in a row.

    The second tells of a k-gram that stands twice inside one run of windows, as
    in periodic text: such a run can repeat itself.
    """
    gram_hash, width = rolling(data, gram), length - gram + 1
    least = _sliding(gram_hash, width, np.minimum)
    edge = np.zeros(width - 1, U)
    chosen = gram_hash[gram_hash == _sliding(np.concatenate([edge, least, edge]), width, np.maximum)]
    return least, np.unique(chosen[1:][chosen[1:] == chosen[:-1]])


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(k-gram hash, row, start in the row, windows, twice) of every run of windows with one owner."""
    found = []
    for low in range(0, max(0, len(data) - length + 1), SLICE):
        part = data[low : low + SLICE + length - 1]
        owner, twice = owners(part, length, gram)
        a = int(np.searchsorted(offsets, low, side="right")) - 1
        b = int(np.searchsorted(offsets, low + len(owner), side="left"))
        inside = np.clip(offsets[a : b + 1], low, low + len(owner)) - low
        row = np.repeat(np.arange(a, b), np.diff(inside))
        whole = np.arange(low, low + len(owner)) + length <= offsets[row + 1]
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (row[1:] != row[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(owner)))
        parts = np.where(whole[start], -(-size // LONGEST_RUN), 0)
        start = np.repeat(start, parts) + LONGEST_RUN * runs(parts)
        left = np.repeat(size, parts) - LONGEST_RUN * runs(parts)
        found.append((owner[start], row[start], start + low - offsets[row[start]], np.minimum(left, LONGEST_RUN), np.isin(owner[start], twice)))
    if not found:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _batch(*columns: tuple[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for _, x in columns], names=[n for n, _ in columns])


def _runs_task(length: int, gram: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                yield runs_of(keys[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    def runs_of(key: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        owner, row, start, count, twice = window_runs(data, offsets, length, gram)
        owner = owner.view(np.int64)
        by = np.argsort(owner, kind="stable")
        owner, row, start, count, twice = owner[by], row[by], start[by], count[by], twice[by]
        first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(first), len(owner)))
        known = np.repeat(size > 1, size) | twice
        # One row per k-gram goes where the k-gram is counted; the rest are known to repeat.
        dealt = np.where(known & ~first, key[row] ^ (start << 20), owner)
        return _batch(("owner", owner), ("key", key[row]), ("span", (start << 11) | (count << 1) | known), ("dealt", dealt))

    return task


def _repeated_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by k-gram: keep those whose k-gram is known or seen to repeat."""
    held = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]

    def rows(keep: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(keep)
        return _batch(("owner", owner[at]), ("key", key[at]), ("span", span[at] >> 1))

    for batch in batches:
        fresh = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        owner, key, span = (np.concatenate(x) for x in zip(held[:3], fresh, strict=True))
        if not len(owner):
            continue
        keep = (span & 1).astype(bool)
        keep[: len(held[3])] |= held[3]
        near = owner[1:] == owner[:-1]
        keep[1:] |= near
        keep[:-1] |= near
        # The last row waits: the next batch may begin with its k-gram.
        held = [owner[-1:], key[-1:], span[-1:], keep[-1:].copy()]
        keep[-1] = False
        yield rows(keep)
    owner, key, span, keep = held
    yield rows(keep)


def _packed_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compressed texts: less to shuffle than Spark's own block compression leaves."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in portions(batches, 1):
        data, at = utf8(batch.column(1))
        raw = memoryview(data)
        packed = [squeeze.compress(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield _batch(("key", batch.column(0)), ("packed", pa.array(packed, pa.binary())), ("rest", batch.column(2)))


def _texts(column: pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor()
    for value in column:
        yield expand.decompress(value.as_py())


def _strings_task(length: int, heavy: frozenset[int]):
    """Candidate runs of each text become strings for the sorting tasks; local copies are settled here."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[bytes] = set()
            out: list[tuple[int, int, int, int, bytes | None]] = []
            keys = batch.column(0).to_pylist()
            order = sorted(range(len(keys)), key=keys.__getitem__)
            texts = batch.column(1)
            for i in order:
                key, text = keys[i], next(_texts(texts.slice(i, 1)))
                spans = batch.column(2)[i].values
                owner, span = (spans.field(j).to_numpy(zero_copy_only=False) for j in (0, 1))
                by = np.argsort(span)
                for own, packed in zip(owner[by].tolist(), span[by].tolist(), strict=True):
                    start, count = packed >> 10, packed & 1023
                    pieces = [(start, count)] if own not in heavy else [(start + j, 1) for j in range(count)]
                    for a, n in pieces:
                        value = text[a : a + n + length - 1]
                        if value in seen:
                            out.append((key ^ (a << 20), key, a, n, None))
                            continue
                        seen.add(value)
                        deal = own if own not in heavy else int.from_bytes(hashlib.blake2b(value, digest_size=8).digest(), "little", signed=True)
                        out.append((deal, key, a, n, value))
            deal, key, start, count, value = zip(*out, strict=True) if out else ((), (), (), (), ())
            yield _batch(
                ("dealt", pa.array(deal, pa.int64())),
                ("key", pa.array(key, pa.int64())),
                ("start", pa.array(start, pa.int64())),
                ("windows", pa.array(count, pa.int64())),
                ("value", pa.array(value, pa.binary())),
            )

    return task


def dealt_blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by their first column in blocks that end between two values of it, at the first such place past ``least`` bytes.

    Batches are cut where blocks end: a block holds less than ``least`` bytes and, beyond them, the rows of one value.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        dealt = batch.column(0).to_numpy(zero_copy_only=False)
        weight = np.cumsum(pc.fill_null(pc.binary_length(batch.column(4)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + ROW_BYTES)
        low, done = 0, 0  # first row, and bytes of the batch, not yet in a block
        while low < len(dealt):
            full = low + int(np.searchsorted(weight[low:], done + least - size))  # the row that fills the block
            last = held[-1].column(0)[-1].as_py() if size >= least else dealt[min(full, len(dealt) - 1)]
            high = len(dealt) if size < least and full >= len(dealt) else int(np.searchsorted(dealt, last, side="right"))
            if high > low:
                held.append(batch.slice(low, high - low))
                size += int(weight[high - 1]) - done
                low, done = high, int(weight[high - 1])
            if low < len(dealt) and held:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _sorting_task(length: int):
    def spans(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        return _batch(("key", key), ("start", start), ("n", count + (length - 1)))

    def sort(rows: pa.Table) -> pa.RecordBatch:
        key, start, count = (rows.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in (1, 2, 3))
        value = rows.column(4).combine_chunks()
        if isinstance(value, pa.ChunkedArray):
            value = pa.concat_arrays(value.chunks)
        alone = value.is_null().to_numpy(zero_copy_only=False)
        settled = (key[alone], start[alone], count[alone])
        live = ~alone
        if not live.any():
            return spans(*settled)
        key, start, count = key[live], start[live], count[live]
        data, _ = utf8(value.filter(pa.array(live)))
        block = Block(data, count, length)
        flag = block.repeats(key, start) & block.is_window
        at = np.flatnonzero(flag)
        if not len(at):
            return spans(*settled)
        new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (block.owner[at[1:]] != block.owner[at[:-1]])])
        head = at[new]
        size = np.diff(np.append(np.flatnonzero(new), len(at)))
        own = block.owner[head]
        return spans(
            np.concatenate([settled[0], key[own]]),
            np.concatenate([settled[1], start[own] + block.offset[head]]),
            np.concatenate([settled[2], size]),
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in dealt_blocks(batches, BLOCK_BYTES):
            yield sort(block)

    return task


def _removed_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and cut them out."""
    for batch in portions(batches, 1):
        rows = []
        for text, spans in zip(_texts(batch.column(1)), batch.column(2), strict=True):
            merged: list[list[int]] = []
            for a, n in sorted((s["start"], s["n"]) for s in spans.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], a + n)
                else:
                    merged.append([a, a + n])
            edges = [0, *(x for span in merged for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in merged], kept))
        size, gone, spans, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
        yield _batch(
            ("key", batch.column(0)),
            ("rest", batch.column(3)),
            ("n_bytes", pa.array(size, pa.int64())),
            ("n_removed", pa.array(gone, pa.int64())),
            ("spans", pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))),
            ("kept", pa.array(kept, pa.binary())),
        )


def repeated_spans(texts: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(key, start, n) of every span of repeats, and (key, packed, rest), for (key, text, rest)."""
    found = texts.select("key", "text").mapInArrow(tidy(_runs_task(length, gram)), "owner long, key long, span long, dealt long")
    sorted_runs = found.repartition("dealt").select("owner", "key", "span").sortWithinPartitions("owner")
    candidates = write_table(sorted_runs.mapInArrow(tidy(_repeated_task), "owner long, key long, span long"), "repeat-runs")
    total = candidates.count()
    most = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    heavy = frozenset(r.owner for r in candidates.groupBy("owner").count().filter(F.col("count") > most).collect()) if total > most else frozenset()
    # Both joins below read all of these columns by the same key, so the texts are exchanged once.
    schema = StructType([StructField("key", LongType()), StructField("packed", BinaryType()), texts.schema["rest"]])
    packed = texts.mapInArrow(tidy(_packed_task), schema).filter(F.col("key").isNotNull())
    per_text = candidates.groupBy("key").agg(F.collect_list(F.struct("owner", "span")).alias("runs"))
    strings = (
        packed.hint("merge")
        .join(per_text, "key")
        .select("key", "packed", "runs", "rest")
        .mapInArrow(tidy(_strings_task(length, heavy)), "dealt long, key long, start long, windows long, value binary")
        .repartition("dealt")
        .sortWithinPartitions("dealt")
    )
    return strings.mapInArrow(tidy(_sorting_task(length)), "key long, start long, n long"), packed


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept, rest) for every row of ``docs`` (doc_id, text).

    ``rest`` holds the row's text_is_null and, in ``carried``, its ``carry`` columns as c0, c1 and so on.

    A byte goes if a string of ``length`` bytes that covers it also starts
    earlier: in a smaller doc_id, or earlier in the same text. Texts are whole
    and taken as UTF-8; a null text is empty, texts under ``length`` bytes keep
    all, matches never cross rows. Rows that repeat a doc_id, and rows without
    one (placed last), are texts of their own, in the order of their texts.
    ``kept`` holds the remaining bytes; a cut may fall inside a character.
    """
    if length < 16 or not 4 <= gram <= length:
        raise ValueError("length must be at least 16 and gram between 4 and length")
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    plain = ids.rows == ids.ids and dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint")
    rows = docs.select("doc_id", "text", F.struct(F.col("doc_id"), F.col("text").isNull().alias("text_is_null"), F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]).alias("carried")).alias("rest"))
    if plain:
        texts = rows.select(F.col("doc_id").cast("long").alias("key"), "text", "rest")
    else:
        ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_last(), "text")
        numbered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "text").withColumn("key", F.monotonically_increasing_id())
        texts = write_table(numbered, "repeat-texts").select("key", "text", "rest")
    spans, packed = repeated_spans(texts, length, gram)
    per_text = spans.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    fields = "key long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"
    schema = StructType([StructField("key", LongType()), texts.schema["rest"], *StructType.fromDDL(fields).fields[1:]])
    out = packed.hint("merge").join(per_text, "key", "left").select("key", "packed", "spans", "rest").mapInArrow(tidy(_removed_task), schema)
    return out.select(F.col("rest.doc_id").alias("doc_id"), "n_bytes", "n_removed", "spans", "kept", "rest")


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeats cut out of ``text`` and n_chars counted anew; texts cut to nothing go.

    Bytes of characters that a cut splits are dropped. Texts that hold no repeat,
    null ones included, stay as they are.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    left = remove_repeats(docs, length, carry=others)
    # Half characters become replacement marks, and only those that the cut made are taken out.
    repaired = F.replace(F.make_valid_utf8(F.col("kept").cast("string")), F.lit("\ufffd"), F.lit(""))
    whole = F.try_validate_utf8(F.col("kept").cast("string"))
    cut = F.col("n_removed") > 0
    text = F.when(F.col("rest.text_is_null"), None).otherwise(F.when(cut, F.coalesce(whole, repaired)).otherwise(F.col("kept").cast("string")))
    fields = [F.col(f"rest.carried.c{i}").alias(c) for i, c in enumerate(others)]
    made = left.select("doc_id", text.alias("text"), cut.alias("cut"), F.struct(F.lit(0).alias("_"), *fields).alias("own")).filter(~F.col("cut") | (F.trim("text") != ""))
    columns = {c: F.col(f"own.{c}") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("own.n_chars"))
    return made.select(*[columns[c].alias(c) for c in docs.columns])
