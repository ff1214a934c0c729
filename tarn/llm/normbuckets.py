"""Exact top-k inner products by norm buckets with local cosine thresholds.

Vectors are sorted by length into buckets. A first pass over the longest ones
gives every query a score that its k-th best reaches at least. For each query and
bucket that score, divided by both lengths, is a local cosine threshold: above 1
the bucket is left out; if high, candidates must fall into the threshold's
interval in the query's largest coordinates; if low, they must only be long
enough. The products of what remains are taken exactly, in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.buffers import tidy
from tarn.llm import vectorblocks as V
from tarn.llm.scratch import write_table

COORDINATES = 4
COORDINATE_COSINE = 0.55
SLACK = 1e-9


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x).cast("double"))


def _products(pair: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, queries = np.frombuffer(pair["ids"], np.int64), np.frombuffer(pair["q_ids"], np.int64)
    return ids, V.matrix(pair["vectors"], pair["dim"], width), queries, V.matrix(pair["q_vectors"], pair["q_dim"], width)


def _first_pass(k: int):
    """For each query the k-th best product in the block, if it holds so many."""

    def search(pair: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        ids, vectors, queries, wanted = _products(pair, max(pair["dim"], pair["q_dim"]))
        products = wanted @ vectors.T  # whole numbers far below 2**53, so exact
        products[queries[:, None] == ids[None, :]] = -np.inf
        if products.shape[1] >= k:
            least = np.partition(products, products.shape[1] - k, axis=1)[:, -k]
            sure = np.isfinite(least)
            rows = np.frombuffer(pair["q_rows"], np.int64)
            yield rows[sure], queries[sure], queries[sure], least[sure].astype(np.int64)

    return search


def _chosen(own: np.ndarray, least: float, norms: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Candidates of a bucket (longest first) that may reach the product ``least``."""
    size, longest = float(np.sqrt(own @ own)), norms[0]
    if least <= 0 or not size or not longest:
        return np.arange(len(norms))  # neither length nor direction rules anything out
    cosine = least / (size * longest) * (1 - SLACK)
    if cosine > 1:
        return np.zeros(0, int)
    reach = int(np.searchsorted(-norms, -(least / size) * (1 - SLACK), side="right"))
    if cosine < COORDINATE_COSINE:
        return np.arange(reach)
    unit = own / size
    inside = np.ones(reach, bool)
    for f in np.argsort(-np.abs(unit))[:COORDINATES]:
        spread = np.sqrt(max(0.0, (1 - unit[f] ** 2) * (1 - cosine**2))) + SLACK
        low = unit[f] * cosine - spread if unit[f] > -cosine else -1.0
        high = unit[f] * cosine + spread if unit[f] < cosine else 1.0
        inside &= (directions[f, :reach] >= low - SLACK) & (directions[f, :reach] <= high + SLACK)
    return np.flatnonzero(inside)


def _pruned(k: int):
    def search(pair: dict) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        ids, vectors, queries, armed = _products(pair, max(pair["dim"] + 1, pair["q_dim"]))
        floors, wanted, vectors = armed[:, 0], np.ascontiguousarray(armed[:, 1:]), np.ascontiguousarray(vectors[:, :-1])
        norms = np.sqrt((vectors * vectors).sum(1))
        by = np.argsort(-norms, kind="stable")
        ids, vectors, norms = ids[by], vectors[by], norms[by]
        directions = np.ascontiguousarray((vectors / np.where(norms > 0, norms, 1)[:, None]).T)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for row, query, least, own in zip(np.frombuffer(pair["q_rows"], np.int64).tolist(), queries.tolist(), floors.tolist(), wanted, strict=True):
            at = _chosen(own, least, norms, directions)
            scores = (vectors if len(at) == len(ids) else vectors[at]) @ own
            keep = np.flatnonzero((scores >= least) & (ids[at] != query))
            at, scores = at[keep], scores[keep]
            top = V.top_rows(scores, ids[at], k)
            out.append((np.full(len(top), row), np.full(len(top), query), ids[at[top]], scores[top].astype(np.int64)))
        yield tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return search


def exact_top_k(vectors: DataFrame, id_column: str, vector_column: str, every: int, k: int, factor: int = 64, rows: int = V.BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    Components become floor(factor * x). Queries are the rows whose id is
    divisible by ``every``; candidates are all rows but the query's own id.
    Vectors that are null or hold null or non-finite components take no part;
    of vectors of unequal length the shorter counts as zero beyond its end. Zero
    vectors take part and score 0. Ties go to smaller ids. Rows that repeat an
    id are candidates each, and queries each: their results stand under the same
    query_id, each numbered from 1. Fewer than k candidates give all of them; an empty
    table gives an empty result.
    """
    table = V.usable(vectors, id_column, vector_column).withColumn("v", scaled(F.col("v"), factor))
    table = write_table(table.withColumn("length", V.length(F.col("v"))), "norm-vectors")
    slots = V.slots_for(table.count(), rows)
    # Ranges of length are buckets; ids split a length that very many vectors share.
    ranged = table.repartitionByRange(slots, F.desc("length"), "id").sortWithinPartitions(F.desc("length"), "id")
    buckets = write_table(V.packed(ranged, rows), "norm-buckets")
    asked = table.filter(F.col("id") % every == 0).select("id", "row", "v")
    spread = V.slots_for(asked.count(), V.QUERY_ROWS)
    queries = V.packed(asked.repartition(spread, "id"), V.QUERY_ROWS)
    longest = buckets.orderBy(F.desc("longest"), "block").limit(1)
    rows_schema = V.found_schema("long")
    named = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    met = named.crossJoin(F.broadcast(longest))  # one block
    first = met.mapInArrow(tidy(V.search_task(_first_pass(k), pa.int64())), rows_schema)
    floors = first.select(F.col("query_row").alias("row"), "score")
    armed = asked.hint("merge").join(floors, "row", "left").select("id", "row", F.concat(F.array(F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))), "v").alias("v"))
    ready = write_table(V.packed(armed.repartition(spread, "id"), V.QUERY_ROWS), "norm-queries")
    found = V.pairs(buckets, ready, slots).mapInArrow(tidy(V.search_task(_pruned(k), pa.int64())), rows_schema)
    return V.best(found, k)
