"""Vectors packed into blocks, and a fixed query set met with every block.

A block row holds a few thousand vectors as one binary value, so query blocks
meet candidate blocks by an ordinary join on the query block's number and the
arithmetic inside a pair of blocks is one NumPy call. What leaves a pair is at
most k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tarn.llm.buffers import tidy

BLOCK_ROWS = 4096
QUERY_ROWS = 1024
SLOTS_A_CORE = 4
BLOCK_SCHEMA = "block long, ids binary, rows binary, vectors binary, dim long, longest double, shortest double"


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, row, v array<double>) of rows that have an id and a vector of finite components; ``row`` tells rows of one id apart."""
    v = F.col(vector_column).cast("array<double>")
    infinite = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & ~infinite)


def length(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def _pack_task(rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
        count = 0

        def pack() -> pa.RecordBatch:
            nonlocal number
            ids, numbers = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            dim = max((len(x) for _, _, part in held for x in part), default=0)
            flat = np.zeros((len(ids), dim))
            for row, x in enumerate(x for _, _, part in held for x in part):
                flat[row, : len(x)] = x
            norm = np.sqrt((flat * flat).sum(1))
            number += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": [number],
                    "ids": [ids.tobytes()],
                    "rows": [numbers.tobytes()],
                    "vectors": [flat.tobytes()],
                    "dim": [dim],
                    "longest": [float(norm.max())],
                    "shortest": [float(norm.min())],
                }
            )

        last = None
        for whole in batches:
            slot = whole.column(3).to_numpy(zero_copy_only=False) if whole.num_columns > 3 else np.zeros(whole.num_rows, np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1], [True]])) if len(slot) else np.zeros(1, int)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if count and slot[a] != last:
                    yield pack()
                    held, count = [], 0
                last, batch = slot[a], whole.slice(a, b - a)
                ids, numbers = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                at, flat = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
                parts = [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
                while len(parts):
                    take = rows - count
                    held.append((ids[:take], numbers[:take], parts[:take]))
                    count += len(parts[:take])
                    ids, numbers, parts = ids[take:], numbers[take:], parts[take:]
                    if count == rows:
                        yield pack()
                        held, count = [], 0
        if count:
            yield pack()

    return task


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors, in the row order of each partition; a block ends where a column ``slot`` changes."""
    return vectors.select("id", "row", "v", *[c for c in vectors.columns if c == "slot"]).mapInArrow(tidy(_pack_task(rows)), BLOCK_SCHEMA)


def matrix(vectors: bytes, dim: int, width: int) -> np.ndarray:
    """A block's vectors, with zeros up to ``width`` components."""
    flat = np.frombuffer(vectors, np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
    return flat if dim == width else np.pad(flat, ((0, 0), (0, width - dim)))


def pairs(candidates: DataFrame, queries: DataFrame, slots: int) -> DataFrame:
    """Every candidate block beside every query block.

    Candidate blocks stay where their slot puts them; the stated query set, in
    blocks, is sent to each slot once, and the two meet in an equi-join on it. There are
    at most SLOTS_A_CORE slots a core, so what is sent grows as the queries do. A merge join at
    every size: Spark takes the exploded queries for as small as their files and would broadcast them.
    """
    slots = min(slots, SLOTS_A_CORE * candidates.sparkSession.sparkContext.defaultParallelism)
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    sent = named.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return candidates.withColumn("slot", F.pmod(F.shiftright("block", 32), F.lit(slots)).cast("int")).hint("merge").join(sent, "slot")


def slots_for(rows: int, block: int = BLOCK_ROWS) -> int:
    return max(1, -(-rows // block))


Search = Callable[[dict], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]


def found_schema(score: str) -> str:
    return f"query_row long, query_id long, vec_id long, score {score}"


def search_task(search: Search, score_type: pa.DataType):
    """Run ``search`` on each pair of blocks; it yields query rows, query ids, candidate ids and scores."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pair = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                for r, q, c, s in search(pair):
                    made = [pa.array(r, pa.int64()), pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(s, score_type)]
                    yield pa.RecordBatch.from_arrays(made, names=["query_row", "query_id", "vec_id", "score"])

    return task


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query row, ties to smaller ids, numbered from 1."""
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending)."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
