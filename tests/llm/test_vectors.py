from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import normbuckets, permutations, vectorblocks


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(700, 12)) * rng.choice([0.2, 1, 4], size=(700, 1))
    data[200:260] = data[200]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    rows += [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, [0.0] * 12), (905, []), (None, [1.0] * 12), (910, [3.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("block", F.lit("x")).withColumn("score", F.lit(1)).repartition(5)


def table(vectors, keep_zero):
    out = []
    for r in vectors.collect():
        v = r.embedding
        if r.vec_id is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        full = np.zeros(12)
        full[: len(v)] = v
        if keep_zero or full.any():
            out.append((r.vec_id, full))
    return out


@pytest.mark.parametrize("rows", [64, 4096])
def test_exact_top_k(vectors, rows):
    found = {}
    for r in normbuckets.exact_top_k(vectors, "vec_id", "embedding", every=20, k=20, rows=rows).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    known = [(i, np.floor(64 * v).astype(np.int64)) for i, v in table(vectors, True)]
    queries = [(i, v) for i, v in known if i % 20 == 0]
    assert set(found) == {i for i, _ in queries}
    for i, v in queries:
        best = sorted((-int(v @ w), j) for j, w in known if j != i)[:20]
        assert sorted(found[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(best)]


def test_nearest_is_exact_on_small_blocks_and_scores_are_exact(vectors):
    known = dict(table(vectors, False))
    rows = permutations.nearest(vectors, "vec_id", "embedding", every=20, k=20, share=1.0).collect()
    assert {r.query_id for r in rows} == {i for i in known if i % 20 == 0}
    for q in {r.query_id for r in rows}:
        got = sorted((r["rank"], r.vec_id) for r in rows if r.query_id == q)
        best = sorted((-float((known[j] * known[q]).sum()), j) for j in known if j != q)[:20]
        assert [j for _, j in got] == [j for _, j in best]
    assert all(abs(r.score - float(known[r.query_id] @ known[r.vec_id])) < 1e-9 for r in rows)


@pytest.mark.parametrize("lengths", [(1.0,), (0.5, 1.0, 2.0)])
def test_recall_over_several_full_blocks_at_the_shipped_share(spark, lengths):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(12_500, 64))
    data /= np.linalg.norm(data, axis=1)[:, None]
    data *= rng.choice(lengths, size=(len(data), 1))
    data = data.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    hit = total = 0
    for q, found in permutations.nearest(df, "vec_id", "embedding", 200, 20).groupBy("query_id").agg(F.collect_set("vec_id")).collect():
        scores = data @ data[q]
        scores[q] = -np.inf
        hit, total = hit + len(set(np.argsort(-scores)[:20].tolist()) & set(found)), total + 20
    assert hit / total >= 0.93


def test_a_query_reads_the_postings_near_its_places():
    place = np.array([[0, 1, 2], [1, 0, 1], [2, 2, 0]], np.int16)  # three pivots, three vectors
    listed, begins = permutations.inverted(place)
    assert listed.tolist() == [[0, 1, 2], [1, 0, 2], [2, 0, 1]] and begins[1].tolist() == [0, 1, 3, 3]
    own = np.array([0, 1, 2], np.int16)
    full = permutations.nearness(listed, begins, own, 3, 2, 3)
    assert full.tolist() == (3 * 3 - np.abs(place - own[:, None]).sum(0)).tolist()
    assert permutations.nearness(listed, begins, own, 1, 0, 3).tolist() == [1, 0, 0]


@pytest.mark.parametrize("search", [normbuckets.exact_top_k, permutations.nearest])
def test_rows_of_one_query_id_are_queries_each(spark, search):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])], "vec_id long, embedding array<double>")
    found = [(r.query_id, r["rank"], r.vec_id) for r in search(df, "vec_id", "embedding", 20, 5).collect()]
    assert sorted(found) == [(0, 1, 1), (0, 1, 2), (0, 2, 1), (0, 2, 2)]


def test_fewer_candidates_than_k_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in normbuckets.exact_top_k(df, "vec_id", "embedding", 20, 5).orderBy("rank").collect()] == [(1, 1, 8192), (2, 1, 8192)]
    assert permutations.nearest(df, "vec_id", "embedding", 20, 5).count() == 2
    none = df.limit(0)
    assert normbuckets.exact_top_k(none, "vec_id", "embedding", 20, 5).count() == 0
    assert permutations.nearest(none, "vec_id", "embedding", 20, 5).count() == 0


def test_ties_go_to_smaller_ids():
    assert list(vectorblocks.top_rows(np.array([1, 2, 2, 0]), np.array([9, 8, 7, 1]), 2)) == [2, 1]


def test_queries_sent_to_all_blocks_are_not_broadcast(spark):
    rows = spark.createDataFrame([(i, i, [float(i), 1.0]) for i in range(40)], "id long, row long, v array<double>")
    blocks = vectorblocks.packed(rows, 4)
    met = vectorblocks.pairs(blocks, blocks, 1_000)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == blocks.count() ** 2
    assert met.agg({"slot": "max"}).first()[0] < vectorblocks.SLOTS_A_CORE * spark.sparkContext.defaultParallelism
