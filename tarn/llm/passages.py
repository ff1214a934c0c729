"""Removal of passages of words that stand in an earlier document, by seeds and their extensions.

Of every window of ``length`` words the smallest hash of its ``gram``-word grams
is its anchor (winnowing), so equal windows have equal anchors at equal places.
Neighbouring windows with one anchor are a run; runs whose anchor occurs nowhere
else are left at once. The others meet at their anchor. There all occurrences are
extended together, a word at a time to either side: a class of occurrences that
agree so far is split by its next word. Two occurrences in one class to the left
over l words and in one class to the right over r words agree on l + r words, so
a window is a repeat if the class pair that covers it has a smaller document.
Windows that touch are joined to maximal repeats.

Work is linear in the occurrences, however many share an anchor: no pairs are
made. Equal runs of a batch are merged before they travel, and anchors above
``HEAVY_SHARE`` of all runs are dealt window by window, by their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tarn.llm.buffers import bounds, chunks, runs, tidy, utf8
from tarn.llm.repeats import HEAVY_LEAST, HEAVY_SHARE, _packed_task, _repeated_task, _texts
from tarn.llm.scratch import write_table
from tarn.llm.shingles import xxh64

LENGTH = 13
GRAM = 5
CHUNK_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20

U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of every word, and the n + 1 word offsets of the rows."""
    begin, end = bounds((data != 32) & ((data < 9) | (data > 13)), offsets)
    return begin, end, np.searchsorted(begin, offsets)


def gram_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of the ``size`` words from every word."""
    n = max(0, len(word) - size + 1)
    total = word[:n].copy()
    for j in range(1, size):
        total = total * U(_BASE) + word[j : n + j]
    total = (total ^ (total >> U(32))) * U(0xD6E8FEB86659FD93)
    return total ^ (total >> U(29))


def anchored_runs(word: np.ndarray, first: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, row, first word in the row, windows, anchor's word in the run) of every run."""
    least, place = gram_hashes(word, gram), np.arange(max(0, len(word) - gram + 1))
    owner = least
    width, span = length - gram + 1, 1
    steps = []
    while 2 * span <= width:
        steps.append(span)
        span *= 2
    for step in [*steps, *([width - span] if width > span else [])]:
        right = least[step:] < least[: len(least) - step]
        least, place = (np.where(right, x[step:], x[: len(x) - step]) for x in (least, place))
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + length <= first[row + 1])
    if not len(at):
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(4))
    place = place[at]
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)])
    count = np.diff(np.append(np.flatnonzero(new), len(at)))
    at, place = at[new], place[new]
    return owner[place], row[at], at - first[row[at]], count, place - at


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns.values()], names=list(columns))


def _runs_task(length: int, gram: int):
    """Runs of all texts; of an anchor that repeats within a chunk one run goes to be counted, the rest is known."""

    def runs_of(key: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        begin, end, first = words(data, offsets)
        owner, row, start, count, anchor = anchored_runs(xxh64(data, begin, end - begin), first, length, gram)
        owner = owner.view(np.int64)
        by = np.argsort(owner, kind="stable")
        owner, row, start, count, anchor = owner[by], row[by], start[by], count[by], anchor[by]
        new = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
        size = np.diff(np.append(np.flatnonzero(new), len(owner)))
        known = np.repeat(size > 1, size)
        dealt = np.where(known & ~new, key[row] ^ (start << 20), owner)
        return _batch(owner=owner, key=key[row], span=(start << 17) | (count << 9) | (anchor << 1) | known, dealt=dealt)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                yield runs_of(keys[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    return task


def gathered(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of slices, one after the other."""
    return data[np.repeat(start, size) + runs(size)]


def first_equal(data: np.ndarray, start: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For every slice the index of the equal slice of the smallest rank; itself, where hashes deceive."""
    h = xxh64(data, start, size)
    by = np.lexsort((rank, size, h))
    same = (h[by][1:] == h[by][:-1]) & (size[by][1:] == size[by][:-1])
    lead = np.empty(len(by), np.int64)
    lead[by] = by[np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), np.arange(len(by)), 0))] if len(by) else by
    other = np.flatnonzero(lead != np.arange(len(lead)))
    differs = gathered(data, start[other], size[other]) != gathered(data, start[lead[other]], size[other])
    wrong = np.bincount(np.repeat(np.arange(len(other)), size[other]), differs, len(other)) > 0
    lead[other[wrong]] = other[wrong]
    return lead


def _seeds_task(length: int, heavy: np.ndarray):
    """Texts and their runs become short strings for the anchors' tasks; copies within a batch are settled here."""

    def seeds_of(key: np.ndarray, doc: np.ndarray, texts: list[bytes], spans: pa.ListArray) -> pa.RecordBatch:
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        begin, end, first = words(data, offsets)
        row = np.repeat(np.arange(len(key)), np.diff(spans.offsets.to_numpy()))
        owner, span = (spans.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        start, count, anchor = span >> 16, (span >> 8) & 255, span & 255
        hot = np.isin(owner, heavy)
        dealt = owner.copy()
        if hot.any():
            parts = np.where(hot, count, 1)
            j, own = runs(parts), np.repeat(np.arange(len(row)), parts)
            split = hot[own]
            row, start, anchor, dealt = row[own], start[own] + j, anchor[own] - j, dealt[own]
            count = np.where(split, 1, count[own])
            window = gram_hashes(xxh64(data, begin, end - begin), length).view(np.int64)
            dealt[split] = window[(first[row] + start)[split]]
        low = first[row] + start
        at = begin[low]
        size = end[low + count + (length - 2)] - at
        lead = first_equal(data, at, size, doc[row])
        settled = doc[row[lead]] < doc[row]
        flat = gathered(data, at, np.where(settled, 0, size))
        edges = np.concatenate([[0], np.cumsum(np.where(settled, 0, size))]).astype(np.int32)
        value = pa.BinaryArray.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
        dealt = np.where(settled, key[row] ^ (start << 20), dealt)
        return _batch(dealt=dealt, key=key[row], doc=doc[row], span=(start << 16) | (count << 8) | anchor, value=value)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            spans, held, low, size = batch.column(3), [], 0, 0
            for i, text in enumerate(_texts(batch.column(1))):
                held.append(text)
                size += len(text)
                if i + 1 == len(key) or size >= CHUNK_BYTES:
                    yield seeds_of(key[low : i + 1], doc[low : i + 1], held, spans.slice(low, len(held)))
                    held, low, size = [], i + 1, 0

    return task


def split(group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Classes of those that are of one class and have one value."""
    return np.unique(group * (int(by.max(initial=0)) + 1) + by, return_inverse=True)[1]


def repeated_windows(dealt: np.ndarray, doc: np.ndarray, anchor: np.ndarray, count: np.ndarray, word: np.ndarray, first: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For every run and window whether its words also stand in an occurrence of a smaller ``doc``.

    ``word`` numbers the words of all runs, ``first`` tells where each run's begin.
    """
    n, most = len(dealt), length - gram
    size = np.diff(first)
    word = np.append(word + 1, 0)  # 0: beyond the run

    def step(group: np.ndarray, place: np.ndarray) -> np.ndarray:
        inside = (place >= 0) & (place < size)
        return split(group, word[np.where(inside, first[:-1] + place, -1)])

    right = [np.unique(dealt, return_inverse=True)[1]]
    for j in range(length):
        right.append(step(right[-1], anchor + j))
    right = right[gram:]
    left = [right[0]]
    for j in range(most):
        left.append(step(left[-1], anchor - 1 - j))
    found = np.zeros((n, most + 1), bool)
    for before in range(most + 1):
        # The window that begins ``before`` words before the anchor.
        at = np.flatnonzero((anchor - before >= 0) & (anchor - before < count))
        group = split(left[before][at], right[most - before][at])
        least = np.full(len(at), np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc[at])
        found[at, (anchor - before)[at]] = least[group] < doc[at]
    return found


def _extended_task(length: int, gram: int):
    """Rows sorted by ``dealt``: extend all occurrences of each anchor, and tell the spans that repeat."""

    def extend(table: pa.Table) -> pa.RecordBatch:
        dealt, key, doc, span = (table.column(i).combine_chunks().to_numpy(zero_copy_only=False) for i in range(4))
        value = table.column(4).combine_chunks()
        value = pa.concat_arrays(value.chunks) if isinstance(value, pa.ChunkedArray) else value
        data, offsets = utf8(value)
        start, count, anchor = span >> 16, (span >> 8) & 255, span & 255
        settled = np.diff(offsets) == 0
        live = np.flatnonzero(~settled)
        begin, end, first = words(data, offsets)
        number = np.unique(xxh64(data, begin, end - begin), return_inverse=True)[1] if len(begin) else begin
        found = repeated_windows(dealt[live], doc[live], anchor[live], count[live], number, np.append(first[live], len(begin)), length, gram)
        edge = np.zeros((len(live), 1), bool)
        rise = found & ~np.hstack([edge, found[:, :-1]])
        fall = found & ~np.hstack([found[:, 1:], edge])
        (row, low), (_, high) = np.nonzero(rise), np.nonzero(fall)
        return _batch(
            key=np.concatenate([key[settled], key[live[row]]]),
            start=np.concatenate([start[settled], start[live[row]] + low]),
            n=np.concatenate([count[settled], high - low + 1]) + (length - 1),
        )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if held and sum(b.nbytes for b in held) >= BLOCK_BYTES:
                # A block ends between two anchors.
                last = held[-1].column(0)[held[-1].num_rows - 1].as_py()
                take = int(np.searchsorted(batch.column(0).to_numpy(zero_copy_only=False), last, side="right"))
                held.append(batch.slice(0, take))
                if take < batch.num_rows:
                    yield extend(pa.Table.from_batches(held))
                    held = [batch.slice(take)]
            else:
                held.append(batch)
        if held:
            yield extend(pa.Table.from_batches(held))

    return task


def _cut_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the spans of each text and leave their words out."""
    for batch in batches:
        keys, made = batch.column(0).to_pylist(), []
        for text, spans in zip(_texts(batch.column(1)), batch.column(2), strict=True):
            merged: list[list[int]] = []
            for a, n in sorted((s["start"], s["n"]) for s in spans.as_py() or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], a + n)
                else:
                    merged.append([a, a + n])
            data = np.frombuffer(text, np.uint8)
            begin, end, _ = words(data, np.array([0, len(data)]))
            keep = np.ones(len(begin), bool)
            for a, b in merged:
                keep[a:b] = False
            size = (end - begin)[keep]
            left = np.full(int(size.sum()) + len(size), 32, np.uint8)
            left[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = gathered(data, begin[keep], size)
            made.append((len(begin), len(begin) - len(size), [{"start": a, "end": b} for a, b in merged], left[:-1].tobytes()))
        n, gone, spans, kept = zip(*made, strict=True) if made else ((), (), (), ())
        yield _batch(
            key=pa.array(keys, pa.int64()),
            rest=batch.column(3),
            n_words=pa.array(n, pa.int64()),
            n_removed=pa.array(gone, pa.int64()),
            spans=pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            kept=pa.array(kept, pa.binary()).cast(pa.string()),
        )


PASSAGES_SQL = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
word AS (SELECT doc_id, place, words[place] AS word FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS place FROM split)),
windows AS (SELECT doc_id, start, array_to_string(words[start:start + 12], ' ') AS sequence FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS start FROM split)),
earliest AS (SELECT sequence, min(doc_id) AS doc FROM windows GROUP BY sequence),
gone AS (SELECT DISTINCT doc_id, start + step AS place FROM (SELECT w.doc_id, w.start, unnest(range(0, 13)) AS step FROM windows w JOIN earliest e ON e.sequence = w.sequence WHERE e.doc < w.doc_id)),
kept AS (SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.place) AS text FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.place = w.place WHERE g.place IS NULL GROUP BY w.doc_id)
SELECT s.doc_id, len(s.words) AS n_words, len(s.words) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""


def numbered(docs: DataFrame) -> DataFrame:
    """(key, text, doc, rest): a number for every row, and one for every doc_id in their order, null last."""
    rest = F.struct(F.col("doc_id"), F.lit(0).alias("_")).alias("rest")
    ids = docs.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids.rows == ids.ids and dict(docs.dtypes)["doc_id"] in ("bigint", "int", "smallint", "tinyint"):
        key = F.col("doc_id").cast("long")
        return docs.select(key.alias("key"), "text", key.alias("doc"), rest)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    rows = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = write_table(rows.withColumn("key", F.monotonically_increasing_id()), "passage-rows")
    firsts = write_table(rows.groupBy("doc_id").agg(F.min("key").alias("doc")), "passage-ids")
    return rows.join(firsts, rows["doc_id"].eqNullSafe(firsts["doc_id"])).select("key", "text", "doc", F.struct(rows["doc_id"], F.lit(0).alias("_")).alias("rest"))


def remove_passages(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for every row of ``docs`` (doc_id, text).

    A word goes if it is in ``length`` consecutive words that also stand in a
    document of a smaller doc_id, judged on the texts as they come. Words are what
    blanks and the control characters 9 to 13 leave apart; texts are whole. The
    spans (start, end; words) are the maximal repeats, ``kept`` holds the other
    words, joined by one space.

    Null and empty texts have no words; texts under ``length`` words keep all.
    Rows of one doc_id do not take words from one another, also where they
    are equal; rows without doc_id come after all others, together. An empty
    table gives no rows; other columns are not read.
    """
    if not 1 <= gram <= length <= 255:
        raise ValueError("length must be at most 255 and gram between 1 and length")
    texts = numbered(docs)
    found = texts.select("key", "text").mapInArrow(tidy(_runs_task(length, gram)), "owner long, key long, span long, dealt long")
    sorted_runs = found.repartition("dealt").select("owner", "key", "span").sortWithinPartitions("owner")
    candidates = write_table(sorted_runs.mapInArrow(tidy(_repeated_task), "owner long, key long, span long"), "passage-runs")
    total = candidates.count()
    most = max(HEAVY_LEAST, int(total * HEAVY_SHARE))
    heavy = [r.owner for r in candidates.groupBy("owner").count().filter(F.col("count") > most).collect()] if total > most else []
    # Both joins below read all of these columns by the same key, so the texts are exchanged once.
    carried = texts.select("key", "text", F.struct("doc", "rest").alias("rest"))
    schema = StructType([StructField("key", LongType()), StructField("packed", BinaryType()), carried.schema["rest"]])
    packed = carried.mapInArrow(tidy(_packed_task), schema).filter(F.col("key").isNotNull())
    per_text = candidates.groupBy("key").agg(F.collect_list(F.struct("owner", "span")).alias("runs"))
    seeds = (
        packed.hint("merge")
        .join(per_text, "key")
        .select("key", "packed", "rest.doc", "runs", "rest")
        .mapInArrow(tidy(_seeds_task(length, np.array(heavy, np.int64))), "dealt long, key long, doc long, span long, value binary")
        .repartition("dealt")
        .sortWithinPartitions("dealt")
    )
    spans = seeds.mapInArrow(tidy(_extended_task(length, gram)), "key long, start long, n long")
    per_row = spans.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    fields = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    schema = StructType([StructField("key", LongType()), carried.schema["rest"], *StructType.fromDDL(fields).fields])
    out = packed.hint("merge").join(per_row, "key", "left").select("key", "packed", "spans", "rest").mapInArrow(tidy(_cut_task), schema)
    return out.select(F.col("rest.rest.doc_id").alias("doc_id"), "n_words", "n_removed", "spans", "kept")
