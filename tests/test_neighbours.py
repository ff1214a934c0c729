from __future__ import annotations

import numpy as np
import pytest

from tarn.operators import neighbours, structure


def frame(spark, points, name="id"):
    return spark.createDataFrame([(int(i), [float(x) for x in p]) for i, p in enumerate(points)], f"{name} long, features array<double>").repartition(3)


def brute(points, targets, k, same):
    d = np.sqrt(((points[:, None, :] - targets[None, :, :]) ** 2).sum(2))
    if same:
        np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return {i: [(int(j), round(float(d[i, j]), 9)) for j in row if np.isfinite(d[i, j])] for i, row in enumerate(order)}


def found_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.point[0], r.place)):
        out.setdefault(r.point[0], []).append((r.target[0], round(r.distance, 9)))
    return out


@pytest.mark.parametrize(("k", "same", "cell", "block", "visits"), [(1, False, 40, 4096, 200_000), (7, True, 25, 16, 30), (3, False, 10_000, 50, 20), (30, True, 10, 7, 100)])
def test_equal_to_brute_force(spark, monkeypatch, k, same, cell, block, visits):
    monkeypatch.setattr(neighbours, "CELL_ROWS", cell)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", block)
    monkeypatch.setattr(neighbours, "VISITS", visits)
    rng = np.random.default_rng(k)
    centres = rng.normal(size=(6, 4)) * 8
    points = np.concatenate([centres[rng.integers(6, size=300)] + rng.normal(size=(300, 4)), np.ones((40, 4)), centres[:1] + 100])
    points = np.round(points, 2)
    targets = points if same else np.round(centres[rng.integers(6, size=250)] + rng.normal(size=(250, 4)), 2)
    found = neighbours.nearest(frame(spark, points), frame(spark, targets, "other"), ["id"], ["other"], k, same=same)
    want = brute(points, targets, k, same)
    got = found_of(found)
    assert {i: [d for _, d in x] for i, x in got.items()} == {i: [d for _, d in x] for i, x in want.items()}
    assert got == want


def test_few_or_no_targets(spark):
    points = np.arange(10.0).reshape(5, 2)
    assert found_of(neighbours.nearest(frame(spark, points), frame(spark, points, "o"), ["id"], ["o"], 9, same=True)) == brute(points, points, 9, True)
    empty = spark.createDataFrame([], "o long, features array<double>")
    assert neighbours.nearest(frame(spark, points), empty, ["id"], ["o"]).count() == 0
    assert neighbours.nearest(spark.createDataFrame([], "id long, features array<double>"), frame(spark, points, "o"), ["id"], ["o"]).count() == 0


def test_far_cells_are_not_visited(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    rng = np.random.default_rng(1)
    points = np.concatenate([rng.normal(size=(200, 2)) + at for at in ((0, 0), (1000, 0), (0, 1000))])
    rows = []
    real = neighbours._met
    monkeypatch.setattr(neighbours, "_met", lambda visits, *a: (rows.append(visits.count()), real(visits, *a))[1])
    assert found_of(neighbours.nearest(frame(spark, points), frame(spark, points, "o"), ["id"], ["o"], 1, same=True)) == brute(points, points, 1, True)
    assert rows[1] < 0.3 * 600 * 30


@pytest.mark.parametrize("sent", [10_000, 60])
def test_distances_to_a_reduction(spark, monkeypatch, sent):
    monkeypatch.setattr(structure, "SENT_VALUES", sent)
    rng = np.random.default_rng(2)
    points, targets = rng.normal(size=(200, 3)), rng.normal(size=(50, 3))
    found = {r.id: r.distance for r in structure.nearest_distances(frame(spark, points), frame(spark, targets), ["id"]).collect()}
    want = brute(points, targets, 1, False)
    assert {i: round(d, 9) for i, d in found.items()} == {i: x[0][1] for i, x in want.items()}


def test_a_point_travels_once_to_a_slot_of_many_cells(spark):
    from tarn.operators import neighbours

    rows = spark.createDataFrame([((i,), [float(i)], float("inf")) for i in range(8)], "point struct<id: long>, features array<double>, bound double")
    pivots, sizes = np.arange(8.0)[:, None], np.ones(8, int)
    within = np.arange(8)[:, None] // 4 == np.arange(2)[None, :]
    met = neighbours._visits(rows, pivots, sizes, np.ones(8), within, 8, False).collect()
    assert len(met) == 16 and all(len(r.cells) == 4 for r in met)
