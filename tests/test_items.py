from __future__ import annotations

from pyspark.sql import functions as F

from tarn.operators.items import ready_items, rolled_up

NEEDS = "array<struct<id:long>>"


def ready(spark, rows):
    df = spark.createDataFrame([(i, d, None if n is None else [(x,) for x in n]) for i, d, n in rows], f"id long, done boolean, needs {NEEDS}")
    return sorted(r.id for r in ready_items(df, ["id"], F.col("done"), F.col("needs")).collect())


def test_ready_items(spark):
    rows = [(1, True, []), (2, False, [1]), (3, False, [2]), (4, False, []), (5, False, None), (6, False, [1, 9]), (7, None, [1]), (None, False, [1])]
    assert ready(spark, rows) == [2, 4, 5, 7]
    assert ready(spark, []) == []


def test_rows_of_one_key_are_one_item(spark):
    assert ready(spark, [(1, True, []), (1, False, []), (2, False, [1]), (3, False, [1]), (3, False, [3])]) == [1]
    assert ready(spark, [(1, True, []), (1, True, [5]), (2, False, [1]), (2, False, [1])]) == [2]


def test_cycles_are_never_ready(spark):
    assert ready(spark, [(1, False, [2]), (2, False, [1]), (3, False, [3])]) == []


def test_rolled_up_tells_nulls_from_totals(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), (None, "x", 4)], "g string, h string, v long")
    made = {(r.depth, r.g, r.h, r.v) for r in rolled_up(df, ["g", "h"], [F.sum("v").alias("v")]).collect()}
    assert made == {(2, "a", "x", 1), (2, "a", None, 2), (2, None, "x", 4), (1, "a", None, 3), (1, None, None, 4), (0, None, None, 7)}
    assert rolled_up(df.limit(0), ["g", "h"], [F.sum("v").alias("v")]).collect() == []
