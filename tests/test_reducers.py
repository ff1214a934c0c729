from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.operators import clustering, drawing, stratified, units, vocabulary
from tarn.operators.features import feature_matrix


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    group = rng.choice(["A", "B", "C"], 4000, p=[0.7, 0.25, 0.05])
    centre = {"A": (0, 0), "B": (6, 6), "C": (-5, 4)}
    rows = [(i, str(g), float(centre[g][0] + rng.normal(0, 0.7)), float(centre[g][1] + rng.normal(0, 0.7))) for i, g in enumerate(group)]
    rows += [(4000, "A", 60.0, 60.0), (4001, "A", -70.0, 55.0)]
    df = spark.createDataFrame(rows, "id long, g string, v1 double, v2 double")
    return feature_matrix(df, ["v1", "v2"])[0].persist()


def test_random_sample_is_exact_and_reproducible(table):
    a, b = (drawing.random_sample(t, 300, ["id"], 1) for t in (table, table.repartition(7)))
    assert a.count() == 300 and {r.id for r in a.collect()} == {r.id for r in b.collect()}
    assert math.isclose(a.agg(F.sum("_weight")).first()[0], 4002)
    assert drawing.random_sample(table, 10**6, ["id"]).count() == 4002 == drawing.subsample(table, 10**6, ["id"]).count()
    with pytest.raises(ValueError):
        drawing.random_sample(table, 0, ["id"])


def test_draws_by_cutoff_equal_a_full_ranking(spark, monkeypatch):
    monkeypatch.setattr(drawing, "EDGE_ROWS", 3)
    df = spark.range(5000).select("id", (F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 50 == 0, "k").otherwise(F.col("id").cast("string")).alias("key"))
    for n in (1, 77, 4999, 5000, 9000):
        own = drawing.smallest(df.drop("g"), n, ["id"], 4)
        placed = drawing.placed(df.withColumn("all", F.lit(0)), ["all"], ["id"], 4).filter(F.col("_place") <= n)
        assert {r.id for r in own[0].collect()} == {r.id for r in placed.collect()} and own[1] == 5000
    takes = spark.createDataFrame([("0", 10), ("1", 5000), ("2", 0)], "g string, _take int")
    own = sorted(r.id for r in drawing.smallest_of_groups(df, ["g"], takes, ["id"], 4).collect())
    wanted = drawing.placed(df, ["g"], ["id"], 4).filter("(g = '0' and _place <= 10) or g = '1'")
    assert own == sorted(r.id for r in wanted.collect())
    # Rows of one key have one digest: exactly as many are drawn.
    assert drawing.smallest(df, 60, ["key"], 4)[0].count() == 60 == drawing.random_sample(df, 60, ["key"], 4).count()


def test_stratified_sample_keeps_shares(table):
    red = stratified.stratified_sample(table, 400, "g", ["id"])
    assert red.count() == 400 and math.isclose(red.agg(F.sum("_weight")).first()[0], 4002, rel_tol=1e-9)
    share = {r.g: r["count"] / 400 for r in red.groupBy("g").count().collect()}
    whole = {r.g: r["count"] / 4002 for r in table.groupBy("g").count().collect()}
    assert all(abs(share[g] - whole[g]) < 0.01 for g in whole)


def greedy(sizes, n):
    raw = [c * n / sum(sizes) for c in sizes]
    a = [min(c, max(1, math.floor(r))) for c, r in zip(sizes, raw, strict=True)]
    for i in sorted(range(len(a)), key=lambda i: (-(raw[i] - a[i]), i)):
        if sum(a) < n and a[i] < sizes[i]:
            a[i] += 1
    while sum(a) > n and any(x > 1 for x in a):
        i = max((i for i in range(len(a)) if a[i] > 1), key=lambda i: (a[i] - raw[i], -i))
        a[i] -= 1
    return a


@pytest.mark.parametrize(("sizes", "n"), [([70, 25, 5], 10), ([1000] + [1] * 40, 60), ([1000] + [1] * 40, 30), ([3, 3, 3], 9), ([50, 30, 20, 7], 33), ([500, 400] + [2] * 30, 40)])
def test_allocation_equals_the_greedy_loop(spark, sizes, n):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "at int, size long")
    assert [r.alloc for r in stratified.allocate(df, n, ["at"]).orderBy("at").collect()] == greedy(sizes, n)


def test_column_choice(spark):
    df = spark.range(100).select((F.col("id") % 2).cast("string").alias("a"), (F.col("id") % 5).cast("string").alias("b"), F.col("id").cast("string").alias("c"), F.lit("x").alias("d"))
    assert stratified.choose_column(df, ["a", "b", "c", "d"]) == "b"
    assert stratified.choose_column(df, ["c", "d"]) is None and stratified.choose_column(df, []) is None


def test_cluster_reduction_adds_up_and_leaves_outliers_out(table):
    red = clustering.cluster_reduce(table, 200, ["id"])
    rows = red.rows.collect()
    assert math.isclose(sum(r._weight for r in rows) + red.excluded, 4002) and red.excluded > 0
    assert len({r.id for r in rows}) == len(rows) and not {4000, 4001} & {r.id for r in rows}
    assert red.members.count() + red.excluded == 4002 and set(rows[0].asDict()) == {"id", "g", "v1", "v2", "features", "_weight"}


def test_virtual_rows_are_means_and_modes(table):
    red = clustering.cluster_reduce(table, 150, ["id"], virtual=True)
    rows = red.rows.collect()
    assert math.isclose(sum(r._weight for r in rows) + red.excluded, 4002) and {r.g for r in rows} <= {"A", "B", "C"}
    with pytest.raises(ValueError):
        clustering.virtual_rows(table, ["v1"])


def test_medoid_and_floor(spark):
    df = spark.createDataFrame([(1, "x", [0.0]), (2, "x", [4.0]), (3, "x", [5.0]), (4, "y", [9.0])], "id long, rep_id string, features array<double>")
    means = clustering.group_means(df, 1)
    assert sorted((r.id, r._weight) for r in clustering.medoids(df, means, ["id"]).collect()) == [(2, 3.0), (4, 1.0)]
    sizes = spark.createDataFrame([(0, 1000), (1, 10)], "c int, size long")
    assert [(r.alloc, r.lifted) for r in clustering.floored_allocation(sizes, 20, ["c"]).orderBy("c").collect()] == [(30, True), (10, True)]


def test_small_tables_have_no_outliers(table):
    few = table.limit(9)
    assert clustering.without_outliers(few, ["id"])[1] == 0
    with pytest.raises(ValueError):
        clustering.cluster_reduce(few, -1, ["id"])


@pytest.fixture(scope="module")
def lines(spark):
    rng = np.random.default_rng(1)
    rows = [(u, k, "ab"[u % 2] if k or u % 5 else "c", None if u % 7 == 0 else "z") for u in range(200) for k in range(rng.integers(1, 6))]
    return spark.createDataFrame(rows, "unit long, k int, s string, t string")


def test_units_stay_whole(lines):
    red = units.stratified_units(lines, ["unit"], ["s", "t"], ["k"], 0.2)
    sizes = {r.unit: r["count"] for r in lines.groupBy("unit").count().collect()}
    kept = {r.unit: r["count"] for r in red.rows.groupBy("unit").count().collect()}
    assert kept == {u: sizes[u] for u in kept} and len(kept) == red.units_kept < red.units_total == 200
    key = lambda r: (r.s, r.t)
    strata = {key(r): r["count"] for r in lines.groupBy("s", "t").count().collect()}
    weights = {key(r): r.w for r in red.rows.groupBy("s", "t").agg(F.sum("_weight").alias("w")).collect()}
    assert all(math.isclose(weights[k], strata[k]) for k in weights) and len(red.notes) >= 1
    report = units.stratum_report(lines, red.rows, ["unit"], ["s", "t"], ["k"]).collect()
    assert sum(r.units_orig for r in report) == 200 and sum(r.units_red for r in report) == red.units_kept
    assert units.unit_summary(lines, ["unit"], ["s", "t"], ["k"]).first().units == 200


def test_unit_errors(lines):
    table = units.unit_table(lines, ["unit"], ["s"], ["k"])
    for ratio in (0, 1.1):
        with pytest.raises(ValueError):
            units.taken_units(table, ratio)
    assert units.taken_units(table, 1.0).count() == 200
    for columns in (["nope"], []):
        with pytest.raises(ValueError):
            units.unit_table(lines, columns, ["s"], ["k"])


@pytest.fixture(scope="module")
def values(spark):
    counts = {"A": 500, "B": 250, "C": 150, "D": 70, "E": 30}
    return spark.createDataFrame([(v, i) for v, n in counts.items() for i in range(n)], "eqp string, row long")


def test_limits(values):
    left, done = vocabulary.limit_values(values, {"eqp": 3})
    done = done.collect()
    assert {r.value: r.rows for r in done[0].kept} == {"A": 500, "B": 250, "C": 150} and left.count() == 900
    assert (done[0].levels_before, done[0].levels_after, done[0].row_coverage) == (5, 3, 0.9) and "5 -> 3" in done[0].summary
    assert vocabulary.choose_values(values, "eqp", 2, "sample").count() == 2
    assert vocabulary.choose_values(values, "eqp", 9).count() == 5
    assert vocabulary.parse_limits("a=3, ,b = 2") == {"a": 3, "b": 2}


@pytest.mark.parametrize(("limits", "mode"), [({"nope": 1}, "top"), ({"eqp": 0}, "top"), ({"eqp": 1}, "other")])
def test_limit_errors(values, limits, mode):
    with pytest.raises(ValueError):
        vocabulary.limit_values(values, limits, mode)


@pytest.mark.parametrize("text", ["a", "a=x"])
def test_limit_text_errors(text):
    with pytest.raises(ValueError):
        vocabulary.parse_limits(text)


def test_subgroups_are_fitted_on_all_rows(spark, monkeypatch):
    monkeypatch.setattr(clustering, "SUB_ROWS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x), float(y)]) for i, (x, y) in enumerate(rng.normal(size=(3000, 2)))]
    df = spark.createDataFrame(rows, "k long, features array<double>")
    found = clustering.subgroups(df, 60, ["k"], 0, 30)[0].collect()
    points, rep = np.array([r.features for r in found]), np.array([r.rep_id for r in found])
    spread = sum(((points[rep == g] - points[rep == g].mean(0)) ** 2).sum() for g in np.unique(rep))
    best = clustering.lloyd(points, len(np.unique(rep)), 0)
    assert spread < 1.25 * (clustering.nearest_centre(points, best)[1] ** 2).sum()


def test_centres_are_means_of_all_rows(spark):
    df = spark.createDataFrame([(i, [float(i % 7)]) for i in range(60_000)], "k long, features array<double>")
    assert abs(clustering.fit_centres(df, 1, 0)[0][0] - np.mean([i % 7 for i in range(60_000)])) < 1e-9


def test_streamed_centres_are_as_tight_as_full_rounds(spark):
    rng = np.random.default_rng(3)
    near = rng.normal(rng.integers(0, 12, (20_000, 1)) * 5.0, 1.0, (20_000, 3))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(near)], "id long, features array<double>").repartition(4, "id").persist()

    def spread(centres):
        return (clustering.nearest_centre(near, centres)[1] ** 2).sum()

    first = near[:: len(near) // 20][:20]
    full = clustering.sub_lloyd(df.select(F.lit(0).alias("_cluster"), "features"), {0: first}, 3)[0]
    made = clustering.stream_centres(df, first)
    assert spread(made) <= 1.02 * spread(full)
    # A centre that nothing is near stays; empty tables move nothing.
    far = np.vstack([first, [[1e6] * 3]])
    assert (clustering.stream_centres(df, far)[-1] == 1e6).all()
    assert (clustering.stream_centres(df.limit(0), first) == first).all()
    df.unpersist()


def test_few_rows_are_drawn_in_one_pass(spark):
    df = spark.range(20_000).selectExpr("id", "id % 3 AS g").persist()
    for n in (1, 500, 19_990, 30_000):
        drawn = drawing.few_smallest(df, n, ["id"], 4)
        assert sorted(r.id for r in drawn.collect()) == sorted(r.id for r in drawing.smallest(df, n, ["id"], 4)[0].collect())
        assert n > 500 or all("tarn-draw" in f for f in drawn.inputFiles())
    same = spark.range(3_000).selectExpr("id", "'k' AS key")
    assert drawing.few_smallest(same, 60, ["key"], 4).count() == 60
    takes = spark.createDataFrame([(0, 40), (1, 0), (2, 9_000)], "g long, _take long")
    whole, once = (sorted(r.id for r in drawing.smallest_of_groups(df, ["g"], takes, ["id"], 4, once=o).collect()) for o in (False, True))
    assert whole == once and len(once) == 40 + 6_666
    df.unpersist()


def test_features_alone_go_to_python_and_members_stay_where_they_are(spark):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(4_000, 3)), 2)
    df = spark.createDataFrame([(i, f"t{i % 7}", [float(v) for v in x]) for i, x in enumerate(points)], "id long, t string, features array<double>").repartition(4)
    centres = rng.normal(size=(6, 3))
    made = clustering.assign(df, centres)
    assert "ArrowEvalPython" in made._jdf.queryExecution().executedPlan().toString()
    gaps = ((points[:, None] - centres) ** 2).sum(2)
    held = {r.id: r for r in made.collect()}
    assert len(held) == 4_000 and all(held[i]["_cluster"] == gaps[i].argmin() and held[i]["_distance"] == pytest.approx(gaps[i].min() ** 0.5) and held[i].t == f"t{i % 7}" for i in held)
    assert made.filter("id < 0").collect() == []
    grouped = made.select("id", "t", "features", F.col("_cluster").cast("long").alias("rep_id")).persist()
    best = clustering.representatives(grouped, ["id"], False)
    assert {"tarn-means", "tarn-gaps"} == {m for f in best.inputFiles() for m in ("tarn-means", "tarn-gaps") if m in f}
    wanted = set()
    for c in range(6):
        at = np.flatnonzero(gaps.argmin(1) == c)
        wanted.add(int(at[((points[at] - points[at].mean(0)) ** 2).sum(1).round(9).argmin()]))
    assert {r.id for r in best.collect()} == wanted and best.agg(F.sum("_weight")).first()[0] == 4_000
    grouped.unpersist()


def test_equal_rows_are_fitted_as_one_point(spark, monkeypatch):
    """Features of few values: no row itself is fitted, and the result is that of all rows."""

    def rows_fitted(*_, **__):
        raise AssertionError("rows were fitted one by one")

    for name in ("stream_centres", "sub_lloyd"):
        monkeypatch.setattr(clustering, name, rows_fitted)
    rng = np.random.default_rng(8)
    values = np.minimum(rng.geometric(0.3, size=(4000, 2)), 8).astype(float)
    values[:3] = 500.0
    df = spark.createDataFrame([(i, f"t{i % 5}", [float(x) for x in v]) for i, v in enumerate(values)], "k long, t string, features array<double>").repartition(3)
    made = clustering.cluster_reduce(df, 40, ["k"], floor=5)
    members = {r.k: r.rep_id for r in made.members.collect()}
    assert made.excluded == 3 and set(members) == set(range(3, 4000))
    groups = {g: sorted(k for k in members if members[k] == g) for g in set(members.values())}
    # The member nearest to the mean of all rows of its group, the smallest key of equals.
    want = {}
    for held in groups.values():
        gap = ((values[held] - values[held].mean(0)) ** 2).sum(1)
        want[min(k for k, g in zip(held, gap, strict=True) if np.isclose(g, gap.min(), rtol=1e-9, atol=1e-12))] = float(len(held))
    assert {r.k: r._weight for r in made.rows.collect()} == want
    rep = np.array([members[k] for k in range(3, 4000)])
    spread = sum(((values[3:][rep == g] - values[3:][rep == g].mean(0)) ** 2).sum() for g in groups)
    best = clustering.lloyd(values[3:] + rng.normal(size=(3997, 2)) * 1e-9, len(groups), 0)
    assert spread < 1.5 * (clustering.nearest_centre(values[3:], best)[1] ** 2).sum() + 1e-9
    means = clustering.cluster_reduce(df, 40, ["k"], virtual=True, floor=5).rows.collect()
    assert sum(r._weight for r in means) == 3997 and np.isclose(sum(r._weight * np.array(r.features) for r in means), values[3:].sum(0)).all()
    # Features that are nearly all different stay rows.
    assert clustering.different_points(df.select("k", F.array(F.col("k").cast("double")).alias("features"))) is None


def test_counted_points_move_as_their_rows_would():
    rng = np.random.default_rng(9)
    points, rows = rng.normal(size=(60, 2)), rng.integers(1, 9, 60).astype(float)
    begin = points[:6]
    assert np.allclose(clustering.moved_centres(points, begin, rows), clustering.moved_centres(np.repeat(points, rows.astype(int), axis=0), begin, np.ones(int(rows.sum()))))
