"""A quality classifier: hashed word n-grams, logistic loss, follow-the-regularised-leader.

The model is fitted on a bounded sample of labelled texts and scores every text
as a sparse dot product with its n-gram frequencies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import chunks, tidy, utf8
from tarn.llm.wordhash import ngrams, tokens

ORDERS = 2
BITS = 18
SAMPLE_ROWS = 12_000  # labelled texts that the model is fitted on, at most
PASSES = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.0, 1e-4


def features(column: pa.Array, orders: int = ORDERS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, n + 1 offsets): square-rooted n-gram counts of each text, scaled to length 1."""
    data, offsets = utf8(column)
    buckets, values, sizes = [], [], []
    for a, b in chunks(offsets):
        bucket, row = ngrams(*tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), orders, bits)
        key, count = np.unique((row << bits) | bucket, return_counts=True)
        row = key >> bits
        value = np.sqrt(count)
        norm = np.sqrt(np.bincount(row, value * value, minlength=b - a))
        buckets.append(key & ((1 << bits) - 1))
        values.append(value / norm[row])
        sizes.append(np.bincount(row, minlength=b - a))
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    return (np.concatenate(buckets), np.concatenate(values), at) if buckets else (np.zeros(0, np.int64), np.zeros(0), at)


class Leader:
    """Per-coordinate FTRL-proximal state for logistic loss; bucket ``size`` is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, value: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
        sigma = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient * gradient


def _train_task(orders: int, bits: int, passes: int):
    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        model = Leader(1 << bits)
        if parts:
            sample = pd.concat(parts, ignore_index=True).sort_values("dealt", kind="stable", ignore_index=True)
            bucket = [np.append(np.frombuffer(x, np.int32), np.int32(1 << bits)) for x in sample["buckets"]]
            value = [np.append(np.frombuffer(x, np.float32), np.float32(1)) for x in sample["values"]]
            label = sample["label"].to_numpy(np.float64)
            for _ in range(passes):
                for i in range(len(sample)):
                    model.update(bucket[i], value[i], label[i])
        yield pd.DataFrame({"weights": [model.weights(slice(None)).astype(np.float32).tobytes()]})

    return task


def _features_task(orders: int, bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, value, at = features(batch.column("text"), orders, bits)
            cut = list(zip(at[:-1], at[1:], strict=True))
            yield pa.RecordBatch.from_pydict(
                {
                    "dealt": batch.column("dealt"),
                    "label": batch.column("label"),
                    "buckets": pa.array([bucket[a:b].astype(np.int32).tobytes() for a, b in cut], pa.binary()),
                    "values": pa.array([value[a:b].astype(np.float32).tobytes() for a, b in cut], pa.binary()),
                }
            )

    return task


def train(labelled: DataFrame, sample: int = SAMPLE_ROWS, orders: int = ORDERS, bits: int = BITS, passes: int = PASSES) -> np.ndarray:
    """Weights for 2**bits buckets and a bias, from at most ``sample`` rows (dealt long, text, label 0/1).

    Rows are visited in the order of ``dealt``. Without rows all weights are 0.
    """
    ready = labelled.select("dealt", "text", F.col("label").cast("int").alias("label")).mapInArrow(
        tidy(_features_task(orders, bits)), "dealt long, label int, buckets binary, values binary"
    )
    fitted = ready.orderBy("dealt").limit(sample).coalesce(1).mapInPandas(_train_task(orders, bits, passes), "weights binary").collect()
    return np.frombuffer(fitted[0].weights, np.float32) if fitted else np.zeros((1 << bits) + 1, np.float32)


def _score_task(weights, orders: int, bits: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            bucket, value, at = features(batch.column(1), orders, bits)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            raw = np.bincount(row, w[bucket] * value, minlength=len(at) - 1) + float(w[-1])
            score = 1 / (1 + np.exp(-np.clip(raw, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return task


def crc_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; an id that is null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def score_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, sample: int = SAMPLE_ROWS, orders: int = ORDERS, bits: int = BITS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Learns from ``labels`` (doc_id, quality) whose id's crc32 modulo ``folds`` is
    not ``held``, from at most ``sample`` of them, the ones with the smallest
    hashed ids. Null labels and labels without a document are left out; of
    several labels of one id the smallest counts, and rows that repeat an id are
    scored each. A null or empty text has no n-grams and gets the bias alone;
    without any labels every score is 0.5. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), folds) != held))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("label")).withColumn("dealt", F.xxhash64("doc_id")).orderBy("dealt", "doc_id").limit(sample)
    # At most ``sample`` short rows are broadcast.
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("dealt", "text", "label")
    weights = spark.sparkContext.broadcast(train(labelled, sample, orders, bits))  # 4 bytes for each of 2**bits buckets
    kind = dict(docs.dtypes)["doc_id"]
    scored = docs.select("doc_id", "text").mapInArrow(tidy(_score_task(weights, orders, bits)), f"doc_id {kind}, score double")
    return scored.select(
        "doc_id",
        (crc_remainder(F.col("doc_id"), folds) == held).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
