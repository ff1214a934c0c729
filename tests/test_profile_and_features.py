from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tarn.operators import features, profile


@pytest.fixture(scope="module")
def frame(spark):
    return spark.range(300).select(
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"),
        F.format_string("S%04d", "id").alias("store_id"),
        F.element_at(F.array(F.lit("n"), F.lit("s"), F.lit("e")), (F.col("id") % 3 + 1).cast("int")).alias("region"),
        (F.col("id") * 7 + 3000).alias("income"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.concat(F.lit("a rather long note that nobody will ever read again "), F.col("id").cast("string")).alias("memo"),
        F.lit("same").alias("fixed"),
    )


def test_kinds_and_selection(frame):
    kinds = {r["name"]: r["kind"] for r in profile.classify(frame).collect()}
    assert kinds == {"date": "datetime", "store_id": "identifier", "region": "categorical", "income": "numeric", "flag": "categorical", "memo": "text", "fixed": "constant"}
    assert profile.default_selection(profile.classify(frame)) == ["region", "income", "flag"]


@pytest.mark.parametrize(("name", "start", "step", "kind"), [("n", 1, 1, "identifier"), ("value", 3000, 7, "numeric"), ("user_id", 3000, 7, "identifier"), ("l_orderkey", 3000, 7, "numeric")])
def test_whole_number_identifiers(spark, name, start, step, kind):
    df = spark.range(300).select((F.col("id") * step + start).alias(name))
    assert profile.classify(df).first()["kind"] == kind


def test_a_number_with_gaps_in_it_is_no_identifier(spark):
    df = spark.range(300).select(F.when(F.col("id") > 5, F.col("id")).alias("user_id"))
    assert profile.classify(df).first()["kind"] == "numeric"


def test_missing(frame):
    holed = frame.withColumn("income", F.when(F.col("income") >= 3210, F.col("income"))).withColumn("region", F.lit(None).cast("string"))
    report = {r["column"]: r["ratio"] for r in profile.missing_report(holed).collect()}
    assert report["region"] == 1.0 and report["income"] == 0.1
    assert profile.missing_reason(holed).startswith("region")
    kept, gone = profile.drop_missing(holed, ["income"])
    assert (kept.count(), gone) == (270, 30) and profile.drop_missing(holed, [])[1] == 0
    assert not profile.classify(holed).filter("name = 'region'").first()["selected"]


def test_groups_by_header(spark):
    files = spark.createDataFrame([("a", ["x", "y"]), ("c", ["p", "q", "r"]), ("b", ["x", "y"])], "file string, header array<string>")
    assert [(r.files, r.merge) for r in profile.group_by_header(files).collect()] == [(["a", "b"], True), (["c"], False)]


def test_features(frame):
    made = features.prepare(frame, profile.classify(frame))
    assert made.names == ["region=e", "region=n", "region=s", "income", "flag"] and made.dropped == 0
    stats = made.rows.agg(F.avg(F.col("features")[3]).alias("m"), F.stddev_pop(F.col("features")[3]).alias("s")).first()
    assert abs(stats.m) < 1e-9 and abs(stats.s - 1) < 1e-9


def test_many_levels_are_encoded_by_share_and_constants_skipped(spark):
    df = spark.range(120).select((F.col("id") % 50).cast("string").alias("code"), F.col("id").cast("double").alias("v"), F.lit(1.0).alias("flat"))
    rows, names, notes = features.feature_matrix(df, ["code", "v", "flat"])
    assert names == ["code#freq", "v"] and len(notes) == 1
    assert {round(r.features[0], 4) for r in rows.collect()} == {0.025, 0.0167}


def test_errors(frame):
    found = profile.classify(frame)
    for chosen in (["nope"], []):
        with pytest.raises(ValueError):
            features.resolve_selection(frame, found, chosen)
    with pytest.raises(ValueError, match="income"):
        features.prepare(frame.withColumn("income", F.lit(None).cast("double")), found, ["income"])
    with pytest.raises(ValueError):
        features.feature_matrix(frame.withColumn("flat", F.lit(1.0)), ["flat"])
    assert features.override_selection(found, None, ["flag"], None) == ["region", "income"]
    assert features.override_selection(found, ["x"], [], None) == ["x"]
