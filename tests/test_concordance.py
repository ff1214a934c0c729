from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from tarn.operators import concordance, fidelity


def sign(x):
    return (x > 0) - (x < 0)


def tau(pairs):
    s = x = y = 0
    for (a, b), (c, d) in itertools.combinations(pairs, 2):
        s += sign(a - c) * sign(b - d)
        x += a != c
        y += b != d
    return s / (x * y) ** 0.5 if x and y else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-6, 6), max_size=40))
def test_inversions(values):
    assert concordance.inversions(np.array(values, float)) == sum(a > b for a, b in itertools.combinations(values, 2))


@pytest.mark.parametrize("slices", [1, 5, 256])
def test_equal_to_all_pairs(spark, monkeypatch, slices):
    monkeypatch.setattr(concordance, "SLICES", slices)
    monkeypatch.setattr(concordance, "SLICE_ROWS", 1)
    rng, rows = random.Random(slices), []
    for _ in range(400):
        a = rng.gauss(0, 1)
        hot = 7.0 if rng.random() < 0.4 else float(rng.randint(0, 20))
        rows.append((a, rng.choice([-0.0, 0.0, a, None, float("nan"), a + rng.gauss(0, 1)]), hot, rng.randint(0, 3), 1.5))
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "a double, b double, c double, d int, e double").repartition(3)
    found = {(r.a, r.b): r.r for r in fidelity.correlation_edges(df, names, "kendall").collect()}
    assert len(found) == 10
    for (i, x), (j, y) in itertools.combinations(enumerate(names), 2):
        there = [(r[i], r[j]) for r in rows if None not in (r[i], r[j]) and r[i] == r[i] and r[j] == r[j]]
        assert found[x, y] == pytest.approx(tau(there), abs=1e-12), (x, y)
    if slices == 5:
        empty = df.limit(0)
        assert [r.r for r in fidelity.correlation_edges(empty, ["a", "b"], "kendall").collect()] == [0.0]
