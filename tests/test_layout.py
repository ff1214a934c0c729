from __future__ import annotations

import numpy as np
import pytest

from tarn.operators import layout, structure


def frame(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, features array<double>").repartition(3)


def rings(seed=0, n=240):
    """Two linked rings in eight dimensions, which no plane shows."""
    rng = np.random.default_rng(seed)
    t = rng.random(n) * 2 * np.pi
    flat = np.zeros((n, 8))
    flat[: n // 2, 0], flat[: n // 2, 1] = np.cos(t[: n // 2]), np.sin(t[: n // 2])
    flat[n // 2 :, 0], flat[n // 2 :, 2] = 1 + np.cos(t[n // 2 :]), np.sin(t[n // 2 :])
    turn = np.linalg.qr(rng.normal(size=(8, 8)))[0]
    return 10 * flat @ turn + rng.normal(size=(n, 8)) * 0.3


def joint(points, perplexity):
    """The dense joint probabilities, each row's width found by bisection of its own."""
    d = ((points[:, None, :] - points[None, :, :]) ** 2).sum(2)
    n, p = len(points), np.zeros((len(points), len(points)))
    for i in range(n):
        others, low, high = np.delete(d[i], i), 1e-12, 1e6
        for _ in range(100):
            beta = np.sqrt(low * high)
            q = np.exp(-(others - others.min()) * beta)
            q /= q.sum()
            low, high = (beta, high) if -(q * np.log(q + 1e-300)).sum() > np.log(perplexity) else (low, beta)
        p[i, np.arange(n) != i] = q
    return (p + p.T) / (2 * n)


def kernel(places):
    q = 1 / (1 + ((places[:, None, :] - places[None, :, :]) ** 2).sum(2))
    np.fill_diagonal(q, 0)
    return q


def divergence(p, places):
    q = kernel(places) / kernel(places).sum()
    return (p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum()


def dense_tsne(p, places, steps=400, early=100):
    speed = np.zeros_like(places)
    for s in range(steps):
        q = kernel(places)
        force = ((12.0 if s < early else 1.0) * p - q / q.sum()) * q
        slope = 4 * (force.sum(1)[:, None] * places - force @ places)
        speed = (0.5 if s < early else 0.8) * speed - 50 * slope
        length = np.sqrt((speed**2).sum(1))[:, None]
        speed *= np.minimum(1.0, 5.0 / np.maximum(length, 1e-12))
        places = places + speed
    return places


def placed(df, n):
    rows = {r.id: (r.x, r.y) for r in df.collect()}
    assert set(rows) == set(range(n))
    return np.array([rows[i] for i in range(n)])


def test_perplexity_and_fuzzy_weights():
    rng = np.random.default_rng(1)
    d = np.sort(rng.random((50, 30)) * rng.choice([0.01, 1, 100], size=(50, 1)), axis=1)
    p = layout.perplexity_weights(d, 12)
    assert np.allclose(p.sum(1), 1) and np.allclose(np.exp(-(p * np.log(p + 1e-300)).sum(1)), 12, rtol=1e-3)
    w = layout.fuzzy_weights(d)
    assert np.allclose(w[:, 0], 1) and np.allclose(w.sum(1), np.log2(30), rtol=1e-3)
    assert np.allclose(layout.perplexity_weights(np.zeros((2, 5)), 30), 0.2)


def test_field_equals_dense_repulsion(spark):
    rng = np.random.default_rng(2)
    places = rng.normal(size=(400, 2)) * 12
    at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(places)], "i long, x double, y double")
    field, q = layout.Field(at), kernel(places)
    want = (q**2).sum(1)[:, None] * places - q**2 @ places
    assert field.total == pytest.approx(q.sum(), rel=0.01)
    assert np.abs(field.push(places) - want).max() < 0.03 * np.abs(want).max()


@pytest.mark.parametrize("rows", [1000, 80])
def test_tsne_is_near_the_dense_one(spark, monkeypatch, rows):
    monkeypatch.setattr(layout, "BLOCK_ROWS", rows)
    steps = 400
    points = rings()
    p = joint(points, 15)
    begin = placed(layout.start(frame(spark, points), "id", 0.1)[0].selectExpr("i AS id", "x", "y"), len(points))
    found = placed(layout.tsne(frame(spark, points), "id", perplexity=15, steps=steps), len(points))
    # Another of several near optima may be reached.
    assert divergence(p, found) < 1.3 * divergence(p, dense_tsne(p, begin, steps, steps // 4)) + 0.02
    assert structure.trust_of(points, projected=found) > structure.trust_of(points) + 0.005


@pytest.mark.parametrize("rows", [1000, 80])
def test_graph_layout_keeps_neighbours(spark, monkeypatch, rows):
    monkeypatch.setattr(layout, "BLOCK_ROWS", rows)
    points = rings(3)
    found = placed(layout.graph_layout(frame(spark, points), "id"), len(points))
    assert structure.trust_of(points, projected=found) > structure.trust_of(points) + 0.005


def test_same_each_time_and_small_tables(spark):
    points = rings(4, 60)
    for make in (layout.tsne, layout.graph_layout):
        one, two = (placed(make(frame(spark, points), "id", steps=20), 60) for _ in range(2))
        assert np.allclose(one, two, atol=1e-6)
        assert np.isfinite(placed(make(frame(spark, [[1.0, 2.0]] * 3), "id", steps=20), 3)).all()
        assert make(frame(spark, [[1.0, 2.0]]), "id").count() == 1
        assert make(spark.createDataFrame([], "id long, features array<double>"), "id").count() == 0


def test_repulsion_in_parts_is_the_whole(monkeypatch):
    monkeypatch.setattr(layout, "MET_AT_ONCE", 64)
    rng = np.random.default_rng(7)
    places, others = rng.normal(size=(150, 2)) * 20, rng.normal(size=(90, 2)) * 20
    q = 1 / (1 + ((places[:, None, :] - others[None, :, :]) ** 2).sum(2))
    push, total = layout.mutual(places, others)
    assert np.allclose(push, (q**2).sum(1)[:, None] * places - q**2 @ others) and total == pytest.approx(q.sum())
