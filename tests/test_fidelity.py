from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import catfidelity, charts, fidelity, ordered, relations, structure
from tarn.operators.drawing import random_sample
from tarn.operators.features import feature_matrix


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(0)
    a = rng.normal(100, 15, 2000)
    return {"id": np.arange(2000), "a": a, "b": 0.8 * a + rng.normal(0, 5, 2000), "c": rng.normal(50, 10, 2000), "g": rng.choice(["x", "y", "z"], 2000, p=[0.6, 0.3, 0.1])}


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = list(zip(*(v.tolist() for v in data.values()), strict=True))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, g string").persist()


def weighted(df):
    return df.withColumn("_weight", F.lit(1.0))


def test_identity_scores_full(frame):
    same = weighted(frame)
    metrics = {r["name"]: r.score for r in fidelity.column_metrics(frame, same, ["a", "b", "g"]).collect()}
    assert metrics == {"a": 100.0, "b": 100.0, "g": 100.0}
    edges = fidelity.correlation_edges(frame, ["a", "b", "c"])
    assert fidelity.correlation_preservation(fidelity.edge_changes(edges, edges)).first().score == 100.0
    assert catfidelity.grouped_similarity(frame, same, ["g"], ["id"], ["g"], ["id"]).first().total == 100.0


def test_shift_lowers_and_weights_count(frame):
    moved = weighted(frame.withColumn("a", F.col("a") + 40))
    assert fidelity.numeric_score(frame, moved, "a").first().score < 80
    half = frame.filter("g = 'x'").limit(200).unionByName(frame.filter("g <> 'x'").limit(200))
    flat = fidelity.categorical_score(frame, weighted(half), "g").first().score
    fair = half.withColumn("_weight", F.when(F.col("g") == "x", 6.0).otherwise(4.0))
    assert fidelity.categorical_score(frame, fair, "g").first().score > flat


def test_empty_side_scores_zero(frame):
    assert fidelity.numeric_score(frame, weighted(frame.limit(0)), "a").first().score == 0.0
    assert fidelity.distribution_score(fidelity.column_metrics(frame, frame, [])).first().score == 0.0


def test_ks_equals_numpy(spark, frame, data):
    part = frame.filter("id % 7 = 0")
    got = ordered.ks_statistic(frame, part, F.col("a")).first().ks
    grid = np.sort(data["a"])
    sub = np.sort(data["a"][::7])
    want = np.abs(np.searchsorted(grid, grid, "right") / 2000 - np.searchsorted(sub, grid, "right") / len(sub)).max()
    assert abs(got - want) < 1e-12


def test_quantiles_and_ranks(spark, data, frame):
    got = ordered.quantiles(frame, "a", [0, 0.001, 0.5, 0.95, 1])
    assert all(abs(v - np.quantile(data["a"], q)) < 1e-9 for q, v in got.items())
    df = spark.createDataFrame([(3.0,), (1.0,), (3.0,), (None,)], "v double")
    assert ordered.quantiles(df.limit(0), "v", [0.5]) == {0.5: None}
    assert sorted(r.v for r in ordered.average_ranks(df.dropna(), ["v"]).collect()) == [1.0, 2.5, 2.5]


def test_one_far_value_leaves_the_slices_even(spark):
    df = spark.range(20_000).select(F.col("id").cast("double").alias("v")).union(spark.createDataFrame([(1e12,), (-1e15,), (float("inf"),)], "v double"))
    sizes = [r["count"] for r in ordered.sliced(df, "v").groupBy("_slice").count().collect()]
    assert max(sizes) < 300 and len(sizes) > 200
    assert ordered.quantiles(df, "v", [0.5])[0.5] == 10_000.0


def test_correlations(frame, data):
    edges = {(r.a, r.b): r.r for r in fidelity.correlation_edges(frame, ["a", "b", "c"]).collect()}
    assert abs(edges["a", "b"] - np.corrcoef(data["a"], data["b"])[0, 1]) < 1e-9
    rank = lambda x: np.argsort(np.argsort(x))
    spear = {(r.a, r.b): r.r for r in fidelity.correlation_edges(frame, ["a", "b"], "spearman").collect()}
    assert abs(spear["a", "b"] - np.corrcoef(rank(data["a"]), rank(data["b"]))[0, 1]) < 1e-9
    flat = fidelity.correlation_edges(frame.withColumn("k", F.lit(2.0)), ["a", "k"]).first()
    assert flat.r == 0.0
    with pytest.raises(ValueError):
        fidelity.correlation_edges(frame, ["a", "b"], "kendall?")


def test_broken_relation(frame):
    torn = frame.select("id", "a", (F.rand(3) * 100).alias("b"), "c")
    o, r = (fidelity.correlation_edges(d, ["a", "b", "c"]) for d in (frame, torn))
    changes = fidelity.edge_changes(o, r)
    assert fidelity.correlation_preservation(changes).first().score < 70
    assert {(x.a, x.b): x.outcome for x in relations.outcomes(changes).collect()}["a", "b"] == "vanished"
    assert [(x.a, x.b, x.status) for x in relations.vanished_and_new(o, r).collect()] == [("a", "b", "vanished")]
    assert relations.ranked_changes(changes).first().b == "b"
    assert relations.difference_matrix(changes).count() == 3
    assert relations.causes(changes, o).first().cause == "representatives"
    assert [x.sign for x in relations.network(o).collect()] == ["positive"]


def test_distribution_table_rolls_up(spark):
    df = spark.createDataFrame([(chr(97 + i % 15),) for i in range(150)], "v string")
    rows = catfidelity.distribution_table(df, weighted(df), ["v", "absent"], top=10).collect()
    assert len(rows) == 11 and sum(r.orig_rows for r in rows) == 150 and any(r.value == "(rest: 5 values)" for r in rows)
    with pytest.raises(ValueError):
        charts.distribution_panels(df, weighted(df), [])


def test_trust_and_coverage(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(400, 2)), rng.normal(size=(400, 6)) * 1e-3], axis=1)
    assert structure.trust_of(x) > 0.95 and structure.trust_of(x[:11]) == 1.0 == structure.trust_of(x[:14])
    assert 0.4 < structure.trust_of(rng.normal(size=(400, 8))) < 0.95
    wide = structure.trust_of(np.arange(40.0)[:, None])
    assert wide == 1.0
    points = rng.normal(size=(1500, 4))
    frame = lambda p: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(p)], "id long, features array<double>")
    df = frame(points)
    near = structure.coverage(df, random_sample(df, 300, ["id"], 5), ["id"])
    far = structure.coverage(df, frame(rng.normal(6, 0.2, size=(300, 4))), ["id"])
    assert near["score"] > 80 > far["score"] and near["sampled"] == 1500
    with pytest.raises(ValueError):
        structure.coverage(df, df.limit(0), ["id"])


def test_coverage_takes_every_row(spark):
    rows = spark.range(structure.COVERAGE_ROWS + 5_000).select("id", F.array(F.col("id").cast("double")).alias("features"))
    found = structure.coverage(rows, rows.filter("id % 1000 = 0"), ["id"])
    distances = [min(i % 1000, 1000 - i % 1000) if i < structure.COVERAGE_ROWS + 4_001 else i % 1000 for i in range(structure.COVERAGE_ROWS + 5_000)]
    assert found["sampled"] == len(distances)
    assert abs(found["p95_distance"] / found["mean_distance"] - np.quantile(distances, 0.95) / np.mean(distances)) < 1e-3


def test_overall():
    assert structure.overall_score(90, 60, 30)["total"] == 60.0
    with pytest.raises(ValueError):
        structure.overall_score(101, 0, 0)


def test_charts(frame):
    rows, _, _ = feature_matrix(frame, ["a", "b", "c"])
    red = random_sample(rows, 100, ["id"])
    points = charts.scatter(rows, red, ["id"])
    assert points.filter("side = 'reduced'").count() == 100
    spread = points.filter("side = 'original'").agg(F.var_pop("pc1").alias("x"), F.var_pop("pc2").alias("y")).first()
    assert spread.x > spread.y > 0
    hist = charts.histogram(rows, red, "a").collect()
    assert len(hist) == 39 and abs(sum(r.original * (r.high - r.low) for r in hist) - 1) < 1e-9
    assert [r.value for r in charts.category_bars(frame, weighted(frame), "g").collect()] == ["x", "y", "z"]
    assert relations.cluster_reflection(frame, frame.filter("g <> 'z'"), "g").filter("status = 'not reflected'").count() == 1


def test_ranks_of_few_values_exchange_no_rows(frame):
    made = ordered.average_ranks(frame.select(F.floor("a").alias("a"), F.floor("b").alias("b")), ["a", "b"])
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
