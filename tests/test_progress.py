from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tarn.plans.progress import progress


def test_fractions_rise_over_attempts(spark):
    seen = []
    with progress(spark, "step", told=lambda step, x: seen.append((step, x)), every=0.05) as step:
        for done in range(3):
            step.attempt(done, 3)
            # Several tasks of some tenths of a second each.
            spark.range(0, 12, 1, 12).mapInPandas(lambda frames: ((time.sleep(0.2), f)[1] for f in frames), "id long").agg(F.sum("id")).collect()
    fractions = [x for _, x in seen]
    assert {s for s, _ in seen} == {"step"}
    assert fractions == sorted(set(fractions)) and len(fractions) > 4
    assert fractions[-1] == 1.0 and any(1 / 3 < x < 2 / 3 for x in fractions)
    assert any(0 < x < 1 / 3 for x in fractions)


def test_a_failed_step_is_not_told_as_done(spark):
    seen = []
    with pytest.raises(ValueError, match="no"), progress(spark, "bad", told=lambda step, x: seen.append(x), every=0.05):
        raise ValueError("no")
    assert 1.0 not in seen
