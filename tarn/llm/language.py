"""Language identification by interpolated Kneser-Ney character models.

Every language gets a model of four-character sequences, fitted on a bounded
sample of labelled texts. All models stand in common sorted hash arrays, one per
order, with a column of log probabilities per language, so one lookup serves all
languages. A text gets the language with the lowest cross-entropy per character;
it is rejected if that is beyond what the language's own held-back texts show.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tarn.llm.buffers import chunks, tidy, utf8
from tarn.llm.quality import crc_remainder
from tarn.llm.wordhash import mix

ORDER = 4
SAMPLE_ROWS = 400  # labelled texts per language, at most
CALIBRATION = 5  # every fifth of them is held back
REJECT_FACTOR = 1.25
SHARPNESS = 5.0
UNKNOWN = "und"
OTHER = 0xFFFF
PREDICTION = ("lang_pred", "score", "nats", "rejected")

U = np.uint64


def _letters() -> np.ndarray:
    """Lower-case code of every letter below 65536, OTHER for letters beyond, and 0 for all else."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = OTHER if c > OTHER else ord(low) if len(low) == 1 else c
    return out


LETTERS = _letters()


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes of all rows with one 0 before, between and after words; codes and letters per row."""
    head = (data & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(head)])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    code = LETTERS[points]
    at = before[offsets]
    first = np.zeros(len(code) + 1, bool)
    first[at] = True
    keep = code != 0
    keep[1:] |= code[:-1] != 0
    keep |= first[:-1] & (code == 0)
    # Every row begins with a 0 of its own, whatever it begins with.
    kept = np.concatenate([[0], np.cumsum(keep)])
    size = np.diff(kept[at])
    letters = np.diff(np.concatenate([[0], np.cumsum(code != 0)])[at])
    out = np.zeros(int(size.sum()) + len(size), np.uint32)
    out[np.arange(int(size.sum())) + np.repeat(np.arange(1, len(size) + 1), size)] = code[keep]
    return out, size + 1, letters


def grams(code: np.ndarray, size: np.ndarray, order: int) -> list[np.ndarray]:
    """Packed sequences of 1 to ``order`` codes that end at every position but the rows' first; short near a row's begin.

    A sequence never reaches over the begin of its row: it is filled with zeros.
    """
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    inner = np.flatnonzero(place > 0)
    out, packed = [], code[inner].astype(U)
    out.append(packed)
    for n in range(1, order):
        back = inner - n
        prior = np.where(place[inner] >= n, code[np.maximum(back, 0)], 0).astype(U)
        packed = packed | (prior << U(16 * n))
        out.append(packed)
    return out


@dataclass
class Counts:
    """Distinct sequences of each order and how often (or after how many letters) they stand."""

    keys: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass
class Model:
    """Sorted hashes per order with log probabilities, and per context with log back-off weights, by language."""

    languages: list[str]
    hashes: list[np.ndarray] = field(default_factory=list)
    logs: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    backoffs: list[np.ndarray] = field(default_factory=list)
    floor: float = 0.0
    limits: np.ndarray | None = None

    def log_probability(self, packed: list[np.ndarray], order: int) -> np.ndarray:
        """One row per position, one column per language."""
        if not order:
            return np.full((len(packed[0]), len(self.languages)), self.floor, np.float32)
        at, hit = _find(self.hashes[order - 1], mix(packed[order - 1]))
        out = self.logs[order - 1][at] if len(self.hashes[order - 1]) else np.zeros((len(at), len(self.languages)), np.float32)
        miss = np.flatnonzero(~hit)
        if len(miss):
            below = self.log_probability([p[miss] for p in packed[: max(1, order - 1)]], order - 1)
            place, known = _find(self.contexts[order - 1], mix(packed[order - 1][miss] >> U(16)))
            below[known] += self.backoffs[order - 1][place[known]]
            out[miss] = below
        return out

    def entropies(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (nats) of each text and language, and letters per text."""
        data, offsets = utf8(column)
        out, letters = np.zeros((len(column), len(self.languages))), np.zeros(len(column), np.int64)
        for a, b in chunks(offsets, 1 << 19):
            code, size, solid = characters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            letters[a:b] = solid
            full = np.flatnonzero(size > 1)
            if not len(full):
                continue
            start = np.cumsum(size[full] - 1) - (size[full] - 1)
            logs = self.log_probability(grams(code, size, ORDER), ORDER)
            out[a + full] = -np.add.reduceat(logs, start, axis=0, dtype=np.float64) / (size[full] - 1)[:, None]
        return out, letters


def build(by_language: dict[str, Counts]) -> Model:
    """Interpolated Kneser-Ney estimates of all languages over the union of their sequences."""
    names = sorted(by_language)
    model = Model(names)
    alphabet = np.unique(np.concatenate([by_language[n].keys[0] for n in names])) if names else np.zeros(0, U)
    model.floor = float(-np.log(len(alphabet) + 1))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([by_language[n].keys[order - 1] for n in names])) if names else np.zeros(0, U)
        context = np.unique(union >> U(16))
        logs, backs = np.zeros((len(union), len(names)), np.float32), np.zeros((len(context), len(names)), np.float32)
        shorter = [union & U((1 << (16 * k)) - 1) for k in range(1, max(2, order))]
        lower = model.log_probability(shorter, order - 1)
        for j, name in enumerate(names):
            keys, counts = by_language[name].keys[order - 1], by_language[name].counts[order - 1].astype(np.float64)
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            at, group = np.unique(keys >> U(16), return_inverse=True)
            total, kinds = np.bincount(group, counts), np.bincount(group)
            place, seen = _find(at, context)
            weight = np.ones(len(context))
            weight[seen] = discount * kinds[place[seen]] / total[place[seen]]
            backs[:, j] = np.log(weight)
            own = np.searchsorted(context, union >> U(16))
            estimate = weight[own] * np.exp(lower[:, j].astype(np.float64))
            mine, hit = _find(keys, union)
            estimate[hit] += np.maximum(counts[mine[hit]] - discount, 0) / total[group[mine[hit]]]
            logs[:, j] = np.log(estimate)
        by, by_context = np.argsort(mix(union)), np.argsort(mix(context))
        model.hashes.append(mix(union)[by])
        model.logs.append(logs[by])
        model.contexts.append(mix(context)[by_context])
        model.backoffs.append(backs[by_context])
    return model


def _counts_of(frame: pd.DataFrame) -> pd.DataFrame:
    data, offsets = utf8(pa.array(frame["text"], pa.string()))
    full = [np.zeros(0, U)]
    for a, b in chunks(offsets):
        code, size, _ = characters(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        full.append(grams(code, size, ORDER)[ORDER - 1])
    keys, counts = np.unique(np.concatenate(full), return_counts=True)
    return pd.DataFrame({"lang": frame["lang"].iloc[:1], "keys": [keys.tobytes()], "counts": [counts.astype(np.int64).tobytes()]})


def _sequences(keys: np.ndarray, counts: np.ndarray) -> Counts:
    out = Counts([keys], [counts])
    for n in range(ORDER - 1, 0, -1):
        shorter, after = np.unique(out.keys[0] & U((1 << (16 * n)) - 1), return_counts=True)
        out.keys.insert(0, shorter)
        out.counts.insert(0, after)
    return out


def fit(labelled: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """A model from (doc_id, text, lang): for each language the ``sample`` texts with the smallest hashed ids."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"))
    chosen = ids.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= sample)
    # At most ``sample`` short rows for each language are broadcast.
    texts = labelled.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("n", "lang", "text")
    held_back = F.col("n") % CALIBRATION == 0
    counted = texts.filter(~held_back).groupBy("lang").applyInPandas(_counts_of, "lang string, keys binary, counts binary").collect()
    tables = {r.lang: _sequences(np.frombuffer(r["keys"], U), np.frombuffer(r["counts"], np.int64)) for r in counted}
    model = build({name: t for name, t in tables.items() if len(t.keys[0])})
    rows = texts.filter(held_back).mapInArrow(tidy(_entropy_task(model)), "lang string, nats double")
    worst = {r.lang: r.nats for r in rows.groupBy("lang").agg(F.max("nats").alias("nats")).collect()}
    spare = max(worst.values(), default=-model.floor)
    # Never nearer to the worst text than half-way to guessing characters.
    model.limits = np.array([max(REJECT_FACTOR * w, (w - model.floor) / 2) for w in (worst.get(n, spare) for n in model.languages)])
    return model


def _entropy_task(model: Model):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nats, letters = model.entropies(batch.column("text"))
            names = batch.column("lang").to_pylist()
            own = [(n, nats[i, model.languages.index(n)]) for i, n in enumerate(names) if n in model.languages and letters[i]]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.string()), pa.array([x for _, x in own], pa.float64())], names=["lang", "nats"])

    return task


def _predict_task(shared, names_out: list[str]):
    """Add the prediction to the rows, which go through as they are; text is the second column."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            nats, letters = model.entropies(batch.column(1))
            if len(model.languages):
                best = nats.argmin(axis=1)
                low = nats[np.arange(len(best)), best]
                score = 1 / np.exp(-SHARPNESS * (nats - low[:, None])).sum(axis=1)
                rejected = low > model.limits[best]
                names = [model.languages[j] if n else UNKNOWN for j, n in zip(best, letters, strict=True)]
            else:
                low, score, rejected = np.zeros(len(letters)), np.zeros(len(letters)), np.ones(len(letters), bool)
                names = [UNKNOWN] * len(letters)
            blank = letters == 0
            found = [pa.array(names, pa.string()), pa.array(np.where(blank, 0.0, score)), pa.array(low), pa.array(rejected | blank)]
            own = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n in names_out]
            yield pa.RecordBatch.from_arrays([*own, *found], names=[*names_out, *PREDICTION])

    return task


def identify(docs: DataFrame, folds: int = 4, held: int = 2, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, nats, rejected) for every row of ``docs`` (doc_id, text, lang).

    Learns from rows whose id's crc32 modulo ``folds`` is not ``held`` and whose
    text and lang are not null. ``lang_pred`` is a learned language, or "und"
    with score 0 if the text is null or has no letter (also if nothing could be
    learned). ``score`` compares the languages' likelihoods of SHARPNESS
    characters. ``rejected`` marks "und" and texts whose cross-entropy is more
    than REJECT_FACTOR times the worst held-back text of their language, and
    half-way from it to the entropy of equally likely characters. Rows
    that repeat an id are predicted each; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = docs.select("doc_id", "text", "lang").filter(crc_remainder(F.col("doc_id"), folds) != held)
    shared = spark.sparkContext.broadcast(fit(known, sample))  # bounded by the sample of each language
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, lang_pred string, score double, nats double, rejected boolean"
    found = docs.select("doc_id", "text").mapInArrow(tidy(_predict_task(shared, ["doc_id"])), schema)
    return found.withColumn("held_out", crc_remainder(F.col("doc_id"), folds) == held).select("doc_id", "held_out", *PREDICTION)


def keep_identified(docs: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    Learns from all labelled rows. A null lang is filled with the prediction; a
    known one stays. Columns named as the prediction's are replaced on the way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang"), sample))
    rest = [c for c in docs.columns if c not in ("doc_id", "text", *PREDICTION)]
    rows = docs.select("doc_id", "text", *rest)
    schema = StructType([*rows.schema.fields, *(StructField(n, t) for n, t in zip(PREDICTION, (StringType(), DoubleType(), DoubleType(), BooleanType()), strict=True))])
    found = rows.mapInArrow(tidy(_predict_task(shared, rows.columns)), schema)
    filled = found.filter(~F.col("rejected")).withColumn("lang", F.coalesce(F.col("lang"), F.col("lang_pred")))
    return filled.select(*[c for c in docs.columns if c not in PREDICTION])
