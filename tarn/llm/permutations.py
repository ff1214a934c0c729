"""Approximate nearest neighbours by a permutation index.

A vector stands for the order in which a fixed set of pivots is near to it. Every
block of vectors has one inverted file per pivot, which lists its vectors by the
place of that pivot in their order. A query reads, in the files of its own nearest
pivots, only the postings near its own place; each posting adds how much nearer it
is than the window's edge, so that the largest sums are the smallest footrule
distances (places outside the window count as its edge). The first of them are
reranked by their exact inner products. For the order of pivots a component is
added that makes all candidates equally long, so that inner products decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import tidy
from tarn.llm import vectorblocks as V
from tarn.llm.scratch import write_table

PIVOTS = 256  # fitted on this many vectors, the documented sample
READ_FILES = 32
WINDOW = 64  # places on either side of the query's own
RERANK_SHARE = 0.2
RERANK_LEAST = 20  # of a small block


def lengthened(vectors: np.ndarray, longest: float) -> np.ndarray:
    """``vectors`` with a first component that makes them ``longest`` long."""
    return np.concatenate([np.sqrt(np.maximum(0.0, longest**2 - (vectors * vectors).sum(1)))[:, None], vectors], axis=1)


def choose_pivots(table: DataFrame, count: int, longest: float) -> np.ndarray:
    """The ``count`` vectors with the smallest hashed ids, lengthened: a sample of fixed size."""
    rows = table.orderBy(F.xxhash64("id"), "id").limit(count).collect()
    width = max((len(r.v) for r in rows), default=0)
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r.v)] = r.v
    return lengthened(out, longest)


def positions(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of every pivot in each vector's order of nearness, one row per pivot."""
    width = min(vectors.shape[1], pivots.shape[1])
    near = vectors[:, :width] @ pivots[:, :width].T
    order = np.argsort(-near, axis=1, kind="stable")
    place = np.empty(order.shape, np.int16)
    np.put_along_axis(place, order, np.arange(order.shape[1], dtype=np.int16)[None, :], axis=1)
    return np.ascontiguousarray(place.T)


def inverted(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per pivot the vectors by the pivot's place, and where each place begins."""
    pivots = len(place)
    listed = np.argsort(place, axis=1, kind="stable").astype(np.int32)
    counts = np.stack([np.bincount(p, minlength=pivots) for p in place]) if pivots else np.zeros((0, 0), int)
    return listed, np.concatenate([np.zeros((pivots, 1), int), np.cumsum(counts, axis=1)], axis=1).astype(np.int32)


def nearness(listed: np.ndarray, begins: np.ndarray, own: np.ndarray, files: int, window: int, rows: int) -> np.ndarray:
    """For each vector of a block the summed nearness of its places to the query's, over the postings read."""
    sums, pivots = np.zeros(rows, np.int32), len(own)
    for place, pivot in enumerate(np.argsort(own, kind="stable")[:files].tolist()):
        low, high = max(0, place - window), min(pivots, place + window + 1)
        edges = begins[pivot, low : high + 1]
        gain = np.repeat(window + 1 - np.abs(np.arange(low, high) - place), np.diff(edges))
        sums[listed[pivot, edges[0] : edges[-1]]] += gain.astype(np.int32)  # a vector stands once in a file
    return sums


def _search(pivots: np.ndarray, files: int, window: int, share: float, k: int):
    def search(pair: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        width = max(pair["dim"], pair["q_dim"])
        ids, queries = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["q_ids"], np.int64)
        vectors, wanted = V.matrix(pair["vectors"], pair["dim"], width), V.matrix(pair["q_vectors"], pair["q_dim"], width)
        listed = np.frombuffer(pair["listed"], np.int32).reshape(len(pivots), len(ids))
        begins = np.frombuffer(pair["begins"], np.int32).reshape(len(pivots), len(pivots) + 1)
        own = positions(np.concatenate([np.zeros((len(queries), 1)), wanted], axis=1), pivots)
        most = min(len(ids), max(RERANK_LEAST, k + 1, int(np.ceil(share * len(ids)))))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for j, (row, query) in enumerate(zip(np.frombuffer(pair["q_rows"], np.int64).tolist(), queries.tolist(), strict=True)):
            sums = nearness(listed, begins, own[:, j], files, window, len(ids))
            at = np.argpartition(-sums, most - 1)[:most] if most < len(ids) else np.arange(len(ids))
            at = at[ids[at] != query]
            scores = (vectors[at] * wanted[j]).sum(1)
            top = V.top_rows(scores, ids[at], k)
            out.append((np.full(len(top), row), np.full(len(top), query), ids[at[top]], scores[top]))
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return search


def _post_task(pivots: np.ndarray, longest: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, blobs = batch.column("dim").to_pylist(), batch.column("vectors")
            files = [inverted(positions(lengthened(V.matrix(blobs[i].as_py(), d, d), longest), pivots)) for i, d in enumerate(dims)]
            for k, name in enumerate(("listed", "begins")):
                batch = batch.append_column(name, pa.array([f[k].tobytes() for f in files], pa.binary()))
            yield batch

    return task


def nearest(
    vectors: DataFrame,
    id_column: str,
    vector_column: str,
    every: int,
    k: int,
    pivots: int = PIVOTS,
    files: int = READ_FILES,
    window: int = WINDOW,
    share: float = RERANK_SHARE,
    rows: int = V.BLOCK_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): k near vectors of each query by inner product.

    Queries are the rows whose id is divisible by ``every``; candidates are all
    rows but those of the query's own id, and every row is posted. ``share`` of
    each block (RERANK_LEAST rows and more than k at least) is reranked. Vectors
    that are null, zero, or hold null or non-finite components take no part; of
    vectors of unequal length the shorter counts as zero beyond its end. Ties go
    to smaller ids; rows that repeat an id are candidates each, and queries each:
    their results stand under the same query_id, each numbered from 1. Fewer
    candidates than k give all; an empty table gives an empty result.
    """
    table = V.usable(vectors, id_column, vector_column).filter(V.length(F.col("v")) > 0)
    whole = table.agg(F.count("*").alias("rows"), F.max(V.length(F.col("v"))).alias("longest")).first()
    slots, longest = V.slots_for(whole.rows, rows), whole.longest or 0.0
    chosen = choose_pivots(table, pivots, longest)
    # Dealt by content, so that the blocks, and with them the result, depend on the rows alone and not on how they lie.
    dealt = table.withColumn("slot", F.pmod(F.xxhash64("id", "v"), F.lit(slots))).repartition("slot").sortWithinPartitions("slot", "id", "v")
    blocks = V.packed(dealt, 2 * rows)
    index = write_table(blocks.mapInArrow(tidy(_post_task(chosen, longest)), V.BLOCK_SCHEMA + ", listed binary, begins binary"), "permutations")
    asked = table.filter(F.col("id") % every == 0)
    spread = V.slots_for(asked.count(), V.QUERY_ROWS)
    queries = V.packed(asked.repartition(spread), V.QUERY_ROWS)
    found = V.pairs(index, queries, slots).mapInArrow(tidy(V.search_task(_search(chosen, files, window, share, k), pa.float64())), V.found_schema("double"))
    return V.best(found, k)
