"""Spelling variants in a corpus, found by pivotal grams.

Bigrams are ordered from rare to frequent over all words. A word's prefix is its
three rarest bigrams, with their places, and all others equal to the last of
them. One edit spoils two bigrams at most, and of two disjoint ones at most one. So
dynamic programming picks the rarest two disjoint bigrams of each prefix, the
pivots: of two near words, the one whose prefix ends earlier in the order has a
pivot that stands in the other's prefix, at the same place or moved as the edit
moves it, and the text on one side of it is untouched. Pivots therefore meet
prefixes of one (bigram, length, place, side, text on that side; where that is
short, also one half of the other side), and the few pairs found are compared by
edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import bounds, chunks, runs, tidy, utf8
from tarn.llm.scratch import write_table

CHUNK_BYTES = 8 << 20
LONG_RUN = 256
SHORT = 4
GRAM = 2
PREFIX = GRAM + 1
SLIP = 97
# A word one edit away, seen from a bigram that the edit left whole: how much longer it is, how far
# the bigram has moved, and which side of it is untouched (replaced; one more; one fewer code point).
SHIFTS = ((0, 0, "left"), (0, 0, "right"), (1, 0, "left"), (1, 1, "right"), (-1, 0, "left"), (-1, -1, "right"))


def _crc_table() -> np.ndarray:
    """The byte table of CRC-32, from its polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & np.uint32(1), (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


CRC = _crc_table()


def crc_states(prefix: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``data``, each carried on from its ``prefix`` CRC, a byte of all at a time."""
    state = prefix.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    by = np.argsort(-size, kind="stable")
    longer = np.flatnonzero(size[by] > LONG_RUN)
    for i in by[longer]:
        state[i] = zlib.crc32(data[start[i] : start[i] + size[i]].tobytes(), int(prefix[i])) ^ 0xFFFFFFFF
    by = by[len(longer) :]
    sizes, at, running = size[by], start[by], state[by]
    for step in range(int(sizes[0]) if len(sizes) else 0):
        n = int(np.searchsorted(-sizes, -step, side="left"))
        running[:n] = CRC[(running[:n] ^ data[at[:n] + step]) & np.uint32(255)] ^ (running[:n] >> np.uint32(8))
    state[by] = running
    return state ^ np.uint32(0xFFFFFFFF)


def words_of(doc_ids: list[str], data: np.ndarray, offsets: np.ndarray, shortest: int, slip: int | None) -> pa.Array:
    """The words of some texts, one for each occurrence: letter runs, slipped, of ``shortest`` code points or more."""
    data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    lead = data == 0xC3  # U+00C0 to U+00FF are this byte and one more
    solid = ((data >= 97) & (data <= 122)) | lead
    solid[1:] |= lead[:-1]
    begins, ends = bounds(solid, offsets)
    size = ends - begins
    leads = np.concatenate([[0], np.cumsum(lead)])
    points = size - (leads[ends] - leads[begins])
    slips: list[str] = []
    plain = np.ones(len(begins), bool)
    if slip:
        row = np.searchsorted(offsets, begins, side="right") - 1
        prefix = np.array([zlib.crc32(f"{d}:".encode()) for d in doc_ids], np.uint32)
        h = crc_states(prefix[row], data, begins, size)
        plain = h % np.uint32(slip) != 0
        for i in np.flatnonzero(~plain):
            run, at = data[begins[i] : ends[i]].tobytes().decode(), int(h[i]) % int(points[i])
            if len(run) > shortest:
                slips.append(run[:at] + run[at + 1 :])
    keep = np.flatnonzero(plain & (points >= shortest))
    size = size[keep]
    flat = data[np.repeat(begins[keep], size) + runs(size)]
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(keep), pa.py_buffer(at), pa.py_buffer(flat))
    return pa.concat_arrays([words, pa.array(slips, pa.large_string())])


def _words_task(shortest: int, slip: int | None):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, CHUNK_BYTES):
                words = words_of(doc_ids[a:b], data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shortest, slip)
                counts = words.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], names=["word", "n"])

    return task


def count_words(docs: DataFrame, shortest: int = 5, least: int = 3, slip: int | None = None) -> DataFrame:
    """(word, n): the letter runs of all texts, of at least ``shortest`` code points and ``least`` occurrences.

    ``slip`` takes a code point out of a run where the CRC-32 of ``doc_id:run``
    is a multiple of it: the one at that number modulo the run's length. Counts
    are summed in each task before words travel.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    parts = texts.mapInArrow(tidy(_words_task(shortest, slip)), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def pivots(ranks: list[int], places: list[int]) -> tuple[int, int]:
    """Which two disjoint bigrams, in order of place, have the rarest ranks together.

    ``best`` is the rarest bigram that ends before the one in hand: the state of
    a dynamic program over places, for one pivot already chosen.
    """
    best, chosen, waiting = None, None, 0
    for i, place in enumerate(places):
        while places[waiting] + GRAM <= place:
            if best is None or ranks[waiting] < ranks[best]:
                best = waiting
            waiting += 1
        if best is not None and (chosen is None or ranks[best] + ranks[i] < ranks[chosen[0]] + ranks[chosen[1]]):
            chosen = (best, i)
    return chosen


SIGNATURE = "word string, n long, length int, last int, grams array<struct<gram:int,place:int,pivot:boolean>>"


def _signatures_task(order: dict[str, int]):
    def signature(word: str) -> tuple[int, list[dict]]:
        grams = sorted((order[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1))
        last = grams[PREFIX - 1][0]
        prefix = sorted((place, rank) for rank, place in grams if rank <= last)
        chosen = pivots([r for _, r in prefix], [p for p, _ in prefix])
        return last, [{"gram": r, "place": p, "pivot": i in chosen} for i, (p, r) in enumerate(prefix)]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = pa.struct([("gram", pa.int32()), ("place", pa.int32()), ("pivot", pa.bool_())])
        for batch in batches:
            words = batch.column(0).to_pylist()
            made = [signature(w) for w in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int32()), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.list_(gram))],
                names=["word", "n", "length", "last", "grams"],
            )

    return task


def gram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram from the rarest on; there are no more than the square of the 90 letters."""
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(GRAM)))).alias("gram"))
    counts = each.groupBy("gram").agg(F.count("*").alias("n")).orderBy("n", "gram").collect()
    return {r.gram: i for i, r in enumerate(counts)}


def _ways(shifts: tuple[tuple[int, int, str], ...]) -> Column:
    """Each shift twice: for the half of the touched side nearer to the word's begin, and for the other."""
    ways = [(*s, half) for s in shifts for half in ("first", "second")]
    return F.explode(F.array(*[F.struct(F.lit(a).alias("longer"), F.lit(m).alias("moved"), F.lit(side).alias("side"), F.lit(half).alias("half")) for a, m, side, half in ways]))


def _key() -> Column:
    """What two near words must share, by a bigram of one of them and a way ``s`` in which they may differ.

    Bigram, length, place and the text on the untouched side. If that is short, one half
    of the touched side is untouched too, and the key holds it; else the second
    half has no key. Halves are told by the other word's length, which both sides know.
    """
    length, place = F.col("length") + F.col("s.longer"), F.col("place") + F.col("s.moved")
    before = F.substring("word", F.lit(1), F.col("place"))
    behind = F.substring("word", F.col("place") + (GRAM + 1), F.col("length"))
    left = F.col("s.side") == "left"
    same, touched = F.when(left, before).otherwise(behind), F.when(left, behind).otherwise(before)
    size = F.when(left, length - place - GRAM).otherwise(place)
    half = F.floor(size / 2).cast("int")
    first = F.col("s.half") == "first"
    part = F.when(first, F.substring(touched, F.lit(1), half)).otherwise(F.right(touched, size - half))
    short = F.length(same) < SHORT
    key = F.xxhash64("gram", length, place, "s.side", same, F.when(short, part).otherwise(""), F.when(short, F.col("s.half")).otherwise(""))
    return F.when(short | first, key)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b), a before b: all pairs of ``words`` (word, n) one edit apart, each once.

    ``words`` holds distinct words of lower-case letters, of four code points at least; read twice, so
    it should be a table.
    """
    signed = write_table(words.mapInArrow(_signatures_task(gram_order(words)), SIGNATURE), "spelling-signatures")
    each = signed.select("word", "n", "last", "length", F.explode("grams").alias("g")).select("word", "n", "last", "length", "g.*")
    posted = each.withColumn("s", _ways(((0, 0, "left"), (0, 0, "right")))).select(_key().alias("key"), F.col("last").alias("ends"), F.col("word").alias("other"), F.col("n").alias("n_other"))
    probes = each.filter("pivot").withColumn("s", _ways(SHIFTS)).select(_key().alias("key"), "last", "word", "n")
    posted, probes = (x.filter(F.col("key").isNotNull()) for x in (posted, probes))
    # Merge joins, here and below: words grow with the corpus, and Spark takes exploded rows for as small as the table they come from.
    met = probes.hint("merge").join(posted, "key").filter((F.col("last") <= F.col("ends")) & (F.col("word") != F.col("other")))
    near = met.filter(F.levenshtein("word", "other", 1) == 1)
    first = F.col("word") < F.col("other")
    pair = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(name) for x, y, name in (("word", "other", "a"), ("other", "word", "b"), ("n", "n_other", "n_a"), ("n_other", "n", "n_b"))]
    return near.select(*pair).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word of ``forms`` (word, form): forms followed to the last.

    Each round doubles the steps taken. A form has at least twice its word's
    occurrences, so there are no more steps than a count has bits.
    """
    links = write_table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = links.select(F.col("word").alias("via"), F.col("root").alias("beyond"))
        after = links.hint("merge").join(further, F.col("root") == F.col("via"), "left")
        links = write_table(after.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling-roots")
        if links.filter("moved").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, outweigh: int = 2, slip: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the texts of ``docs`` (doc_id, text).

    Words are runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are
    lower-cased, with at least ``shortest`` (four or more) code points and ``least``
    occurrences. Near words are one inserted, deleted or replaced code point apart,
    n_near counts them. The form is the near word that occurs most, of equal ones
    the first in code-point order, if it occurs ``outweigh`` times as often as the
    word or more, else null; the root is the last of the forms that follow one
    another, or the word itself.

    Null, empty and letterless texts have no words; repeated rows count again; an
    empty table gives no rows; other columns are not read. A null doc_id is written
    as nothing where ``slip`` asks for it.
    """
    if shortest < 2 * GRAM or outweigh < 2:
        raise ValueError("words need four code points or more, and forms twice the occurrences or more")
    words = write_table(count_words(docs, shortest, least, slip), "spelling-words")
    pairs = write_table(near_pairs(words), "spelling-pairs")
    both = pairs.union(pairs.select("b", "a", "n_b", "n_a")).toDF("word", "other", "n", "n_other")
    best = F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other").alias("other")))
    linked = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    outweighs = -F.col("best.less") >= outweigh * F.col("n")
    told = write_table(linked.select("word", "n_near", F.when(outweighs, F.col("best.other")).alias("form"), F.when(outweighs, -F.col("best.less")).alias("form_n")), "spelling-forms")
    ends = roots(told.filter(F.col("form").isNotNull()).select("word", "form"))
    return (
        words.hint("merge").join(told, "word", "left")
        .hint("merge")
        .join(ends, "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
    )
