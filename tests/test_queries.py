from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from tarn.operators import catfidelity, features, structure, units
from tarn.plans import catalogue, search

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, (float, np.floating)):
        return None if value != value else round(float(value), 6)
    return value.item() if isinstance(value, np.generic) else value


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, duck, name):
    made = catalogue.QUERIES[name](spark, SF)
    wanted = duck.sql(catalogue.SQL[name])
    names = sorted(made.columns)
    assert names == sorted(wanted.columns)
    ours = sorted(str(tuple(plain(r[c]) for c in names)) for r in made.collect())
    theirs = sorted(str(tuple(plain(v) for v in row)) for row in wanted.project(", ".join(f'"{c}"' for c in names)).fetchall())
    assert ours == theirs


def test_entry_and_registry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_size_candidates():
    assert search.size_candidates(100) == [10, 16, 27, 45, 74] and search.size_candidates(5) == []
    assert search.size_candidates(500_000)[-1] == 50_000


def test_search_and_comparison(spark):
    df = catalogue.read(spark, SF, "orders")
    problem = search.Problem(features.prepare(df, None, ["o_totalprice", "o_orderpriority", "o_custkey"]), ["o_orderkey"])
    best, curve = search.search_size(problem, target=60)
    assert best.score >= 60 and curve[-1]["score"] == best.score
    best, table = search.choose_method(problem, 120)
    assert [t["method"] for t in table] == list(search.METHODS) and best.score == max(t["score"] for t in table)
    with pytest.raises(ValueError):
        search.attempt(problem, "other", 10)


def test_tiny_tables_are_tried_whole(spark):
    df = catalogue.read(spark, SF, "nation")
    problem = search.Problem(features.prepare(df.limit(8), None, ["n_regionkey"]), ["n_nationkey"])
    assert search.search_size(problem, method="random")[0].size == 8
    with pytest.raises(ValueError):
        search.attempt(problem, "stratified", 4)


def test_ratio_search_keeps_the_last(spark):
    line = catalogue.read(spark, SF, "lineitem")
    made = search.search_ratio(line, catalogue.UNIT, catalogue.STRATA, catalogue.ORDER, catalogue.COLUMNS, target=101)
    assert made.ratio == search.RATIOS[-1]


@pytest.mark.parametrize("combos", [None, [["l_returnflag", "l_linenumber"], ["absent", "l_tax"]]])
def test_ladder_scores_equal_each_ratio_alone(spark, combos):
    line = catalogue.read(spark, SF, "lineitem").withColumn("l_linestatus", F.when(F.col("l_partkey") % 7 != 0, F.col("l_linestatus")))
    made = catfidelity.ladder_scores(line, catalogue.COLUMNS, catalogue.UNIT, catalogue.STRATA, catalogue.ORDER, (0.05, 0.3), combos)
    for r in made.collect():
        red = units.stratified_units(line, catalogue.UNIT, catalogue.STRATA, catalogue.ORDER, r.ratio)
        alone = catfidelity.grouped_similarity(line, red.rows, catalogue.COLUMNS, catalogue.UNIT, catalogue.STRATA, catalogue.ORDER, combos).first()
        assert (r.total, r["columns"], r.combos, r.unit_size) == pytest.approx((alone.total, alone["columns"], alone.combos, alone.unit_size), abs=0.051)
        assert (r.units_kept, r.rows_kept) == (red.units_kept, red.rows.count())


def test_ladder_without_units_has_no_total(spark):
    few = spark.createDataFrame([(i, "s") for i in range(5)], "u long, s string")
    made = catfidelity.ladder_scores(few, [], ["u"], ["s"], ["u"], (0.01, 1.0), [["absent"]], min_units=0).orderBy("ratio").collect()
    assert [(r.units_kept, r.total) for r in made] == [(0, None), (5, 100.0)]
    with pytest.raises(ValueError):
        search.search_ratio(few, ["u"], ["s"], ["u"], [], min_units=0, ratios=(0.01,))
    with pytest.raises(ValueError):
        search.search_ratio(few, ["u"], ["s"], ["u"], [], ratios=(0.0, 1.5))


def test_rows_of_a_search_lie_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(search, "PART_ROWS", 100)
    problem = catalogue.problem_of(spark, SF)
    parts = [r["count"] for r in problem.rows.groupBy(F.spark_partition_id()).count().collect()]
    assert len(parts) == -(-problem.total // 100) and max(parts) < 200
    problem.rows.unpersist()


def test_trustworthiness_takes_its_draw_and_not_all_rows_into_one_task(spark):
    made = structure.trustworthiness(catalogue.problem_of(spark, SF).rows, ["o_orderkey"], limit=50)
    assert made.first().sampled == 50
    assert "Coalesce 1" not in made._jdf.queryExecution().executedPlan().toString()


def test_parts_of_unit_reports_are_made_once(spark):
    line, kept = catalogue.units_of(spark, SF)
    assert all("tarn-weighted" in f for f in kept.inputFiles())
    scored = catfidelity.unit_size_score(line, kept, catalogue.UNIT, catalogue.STRATA, catalogue.ORDER)
    assert all("tarn-unit-sizes" in f for f in scored.inputFiles())
    assert all("tarn-changes" in f for f in catalogue.difference_matrix(spark, SF).inputFiles())


def test_values_alone_travel_to_their_units(spark, monkeypatch):
    made, kept = {}, catfidelity.written
    monkeypatch.setattr(catfidelity, "written", lambda df, name: made.setdefault(name, df) and kept(df, name))
    line = catalogue.read(spark, SF, "lineitem")
    catfidelity.ladder_scores(line, catalogue.COLUMNS, catalogue.UNIT, catalogue.STRATA, catalogue.ORDER, (0.1,))
    plan = made["counts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "_v0" in plan.partition("Join")[2] and "array(" not in plan.partition("Join")[2]
