"""How faithful a unit-preserving reduction is: values, combinations, unit sizes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.expressions import composite_key, js_distance, js_term, level
from tarn.functions.tables import written
from tarn.operators.fidelity import divergence, level_shares
from tarn.operators.ordered import ks_of_counts
from tarn.operators.units import laddered_units, unit_table

SCORES = "name string, score double, js double, max_gap double, levels long, coverage double"


def _rated(d: DataFrame, *keys: str) -> DataFrame:
    off = 0.6 * F.col("js") + 0.4 * F.col("max_gap")
    return d.select(
        *keys,
        F.round(100 * (1 - F.least(F.lit(1.0), off)), 1).alias("score"),
        F.round("js", 4).alias("js"),
        F.round("max_gap", 4).alias("max_gap"),
        "levels",
        F.round("coverage", 4).alias("coverage"),
    )


def ratio_similarity(original: DataFrame, reduced: DataFrame, key: Column) -> DataFrame:
    """One row (score, js, max_gap, levels, coverage) for the shares of a key; ``reduced`` has _weight."""
    return _rated(divergence(level_shares(original, reduced, key)))


def stacked(df: DataFrame, columns: Sequence[str], weight: Column) -> DataFrame:
    """(column, value, n, w) of all columns in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), level(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p"), weight.alias("_w")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"), F.sum("_w").alias("w"))


def value_shares(original: DataFrame, reduced: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, orig_rows, reduced_rows, p, q) over the values of either side."""
    o = stacked(original, columns, F.lit(1.0)).select("column", "value", F.col("n").alias("orig_rows"))
    r = stacked(reduced, columns, F.col("_weight")).select("column", "value", F.col("n").alias("reduced_rows"), "w")
    both = o.join(r, ["column", "value"], "full_outer").na.fill(0, ["orig_rows", "reduced_rows", "w"])
    sums = both.groupBy("column").agg(F.sum("orig_rows").alias("all_o"), F.sum("w").alias("all_r"))
    shares = both.join(F.broadcast(sums), "column")  # one row per column
    return shares.select("column", "value", "orig_rows", "reduced_rows", (F.col("orig_rows") / F.col("all_o")).alias("p"), F.coalesce(F.try_divide("w", "all_r"), F.lit(0.0)).alias("q"))


def column_scores(original: DataFrame, reduced: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, score, js, max_gap, levels, coverage), one row per column."""
    if not columns:
        return original.sparkSession.createDataFrame([], SCORES)
    d = value_shares(original, reduced, columns).groupBy(F.col("column").alias("name")).agg(
        js_distance(F.sum(js_term(F.col("p"), F.col("q")))).alias("js"),
        F.max(F.abs(F.col("p") - F.col("q"))).alias("max_gap"),
        F.count("*").alias("levels"),
        F.avg((F.col("q") > 0).cast("int")).alias("coverage"),
    )
    return _rated(d, "name")


def combo_scores(original: DataFrame, reduced: DataFrame, combos: Sequence[Sequence[str]]) -> DataFrame:
    """As column_scores for combinations of columns; those with absent columns are skipped."""
    rows = [
        ratio_similarity(original, reduced, composite_key(original, combo)).select(F.lit("+".join(combo)).alias("name"), "*")
        for combo in combos
        if all(c in original.columns for c in combo)
    ]
    return reduce(DataFrame.unionByName, rows) if rows else original.sparkSession.createDataFrame([], SCORES)


def mean_score(scores: DataFrame) -> DataFrame:
    """One row (score): the mean, 1 decimal; 100 for no rows."""
    return scores.agg(F.coalesce(F.round(F.avg("score"), 1), F.lit(100.0)).alias("score"))


def unit_size_score(original: DataFrame, reduced: DataFrame, units: Sequence[str], strata: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row on rows per unit: score, ks, and mean and most on both sides; 0 if a side is empty.

    Units are counted by their rows once a side; those counts, fewer than sqrt(2n) for n rows, give all figures.
    """
    rows = [df.groupBy(composite_key(df, units)).agg(F.count("*").cast("double").alias("v")) for df in (original, reduced)]
    sizes = [per_unit.groupBy("v").agg(F.count("*").alias("n")) for per_unit in rows]
    o, r = (written(counted, "unit-sizes") for counted in sizes)
    means = [df.agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias(f"m{k}"), F.max("v").cast("long").alias(f"x{k}")) for k, df in (("o", o), ("r", r))]
    both = means[0].crossJoin(means[1]).crossJoin(ks_of_counts(o, r))  # one row each
    return both.select(
        F.coalesce(F.round(100 * (1 - F.least(F.lit(1.0), F.col("ks"))), 1), F.lit(0.0)).alias("score"),
        F.round("ks", 4).alias("ks"),
        F.round("mo", 3).alias("mean_orig"),
        F.round("mr", 3).alias("mean_reduced"),
        F.col("xo").alias("max_orig"),
        F.col("xr").alias("max_reduced"),
    )


def distribution_table(original: DataFrame, reduced: DataFrame, columns: Sequence[str], top: int = 10) -> DataFrame:
    """Per column the ``top`` values by original share and one row for the rest, with the gap in points."""
    there = [c for c in columns if c in original.columns and c in reduced.columns]
    shares = value_shares(original, reduced, there).filter(F.col("orig_rows") > 0)
    order = Window.partitionBy("column").orderBy(F.desc("orig_rows"), "value")
    ranked = shares.withColumn("place", F.least(F.row_number().over(order), F.lit(top + 1)))
    rolled = ranked.groupBy("column", "place").agg(
        F.count("*").alias("values"), F.min("value").alias("value"), F.sum("orig_rows").alias("orig_rows"), F.sum("p").alias("p"), F.sum("reduced_rows").alias("reduced_rows"), F.sum("q").alias("q")
    )
    rest = F.concat(F.lit("(rest: "), F.col("values").cast("string"), F.lit(" values)"))
    return rolled.select(
        "column",
        F.when(F.col("place") > top, rest).otherwise(F.col("value")).alias("value"),
        "orig_rows",
        F.col("p").alias("orig_ratio"),
        "reduced_rows",
        F.col("q").alias("reduced_ratio"),
        ((F.col("q") - F.col("p")) * 100).alias("gap_pp"),
    )


def grouped_similarity(
    original: DataFrame, reduced: DataFrame, columns: Sequence[str], units: Sequence[str], strata: Sequence[str], order: Sequence[str], combos: Sequence[Sequence[str]] | None = None
) -> DataFrame:
    """One row (total, columns, combos, unit_size): the mean of three scores, combos defaulting to the strata."""
    a = mean_score(column_scores(original, reduced, columns)).select(F.col("score").alias("columns"))
    b = mean_score(combo_scores(original, reduced, combos or [strata])).select(F.col("score").alias("combos"))
    c = unit_size_score(original, reduced, units, strata, order).select(F.col("score").alias("unit_size"))
    return a.crossJoin(b).crossJoin(c).select(F.round((F.col("columns") + F.col("combos") + F.col("unit_size")) / 3, 1).alias("total"), "columns", "combos", "unit_size")  # one row each


def _mean_scores(kind: str, rungs: int) -> list[Column]:
    """Per rung the mean of the rounded scores of one kind of key; 100 for none."""
    of_kind = [F.avg(F.when(F.col("kind") == kind, F.col(f"s{i}"))) for i in range(rungs)]
    return [F.coalesce(F.round(x, 1), F.lit(100.0)).alias(f"{kind}{i}") for i, x in enumerate(of_kind)]


def ladder_scores(
    df: DataFrame,
    columns: Sequence[str],
    units: Sequence[str],
    strata: Sequence[str],
    order: Sequence[str],
    ratios: Sequence[float],
    combos: Sequence[Sequence[str]] | None = None,
    min_units: int = 1,
    seed: int = 0,
    table: DataFrame | None = None,
) -> DataFrame:
    """(ratio, units_kept, rows_kept, total, columns, combos, unit_size): grouped_similarity of every ratio from one draw.

    A larger ratio keeps the units of a smaller one, so a unit needs only the first rung
    that keeps it (laddered_units), and rows are counted once by value, stratum and rung;
    each ratio is a column of weighted sums over those counts. Rows meet their unit's rung
    in one exchange; the counts are a written table. Combinations with absent columns are skipped. A ratio that keeps no
    unit has no total. Rows per unit do not change, so unit sizes are compared by the
    table of units, by their distinct sizes: with n rows there are fewer than sqrt(2n).
    """
    rungs = sorted(set(ratios))
    every = range(len(rungs))
    named = [("columns", c, level(c)) for c in columns]
    named += [("combos", "+".join(c), composite_key(df, c)) for c in (combos or [strata]) if all(x in df.columns for x in c)]
    named = named or [("strata", "", composite_key(df, strata))]
    table = unit_table(df, units, strata, order) if table is None else table
    placed = written(laddered_units(table, rungs, min_units, seed).select("unit", "rows", "rung"), "rungs")

    keyed = df.select(
        composite_key(df, units).alias("_unit"),
        composite_key(df, strata).alias("_stratum"),
        *[v.alias(f"_v{i}") for i, (_, _, v) in enumerate(named)],
    )
    # Values alone travel to their unit; which key they are of is told after the join.
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name"), F.col(f"_v{i}").alias("value")) for i, (k, n, _) in enumerate(named)])
    rows = keyed.join(placed.select(F.col("unit").alias("_unit"), "rung"), "_unit").select("_stratum", "rung", F.explode(keys).alias("k"))
    counts = written(rows.groupBy("k.kind", "k.name", "k.value", "_stratum", "rung").agg(F.count("*").alias("n")), "counts")

    # Every row has one value of each key: the first key's counts are those of the strata.
    first = counts.filter((F.col("kind") == named[0][0]) & (F.col("name") == named[0][1]))
    kept = [F.sum(F.when(F.col("rung") <= i, F.col("n"))) for i in every]
    factors = first.groupBy("_stratum").agg(*[F.coalesce(F.try_divide(F.sum("n"), x), F.lit(0.0)).alias(f"f{i}") for i, x in enumerate(kept)])
    weighed = counts.join(factors, "_stratum").groupBy("kind", "name", "value").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col("rung") <= i, F.col("n") * F.col(f"f{i}")).otherwise(0.0)).alias(f"w{i}") for i in every]
    )
    sums = weighed.groupBy("kind", "name").agg(F.sum("n").alias("all"), *[F.sum(f"w{i}").alias(f"all{i}") for i in every])
    shares = weighed.join(F.broadcast(sums), ["kind", "name"]).select(  # one row per key
        "kind", "name", (F.col("n") / F.col("all")).alias("p"), *[F.coalesce(F.try_divide(f"w{i}", f"all{i}"), F.lit(0.0)).alias(f"q{i}") for i in every]
    )
    p = F.col("p")
    apart = [0.6 * js_distance(F.sum(js_term(p, F.col(f"q{i}")))) + 0.4 * F.max(F.abs(p - F.col(f"q{i}"))) for i in every]
    per_key = shares.groupBy("kind", "name").agg(*[F.round(100 * (1 - F.least(F.lit(1.0), x)), 1).alias(f"s{i}") for i, x in enumerate(apart)])
    means = per_key.agg(*_mean_scores("columns", len(rungs)), *_mean_scores("combos", len(rungs)))

    sizes = placed.groupBy("rows").agg(F.count("*").alias("n"), *[F.count_if(F.col("rung") <= i).alias(f"n{i}") for i in every])
    upto, whole = Window.orderBy("rows"), Window.partitionBy()
    gaps = sizes.select(
        *[F.col(f"n{i}") for i in every], *[(F.col("rows") * F.col(f"n{i}")).alias(f"r{i}") for i in every],
        *[F.abs(F.sum("n").over(upto) / F.sum("n").over(whole) - F.try_divide(F.sum(f"n{i}").over(upto), F.sum(f"n{i}").over(whole))).alias(f"g{i}") for i in every],
    )
    fits = gaps.agg(*[x for i in every for x in (
        F.coalesce(F.round(100 * (1 - F.least(F.lit(1.0), F.max(f"g{i}"))), 1), F.lit(0.0)).alias(f"size{i}"), F.sum(f"n{i}").alias(f"units{i}"), F.sum(f"r{i}").alias(f"rows{i}"))])

    rung = [F.struct(
        F.lit(float(r)).alias("ratio"), F.col(f"units{i}").alias("units_kept"), F.col(f"rows{i}").alias("rows_kept"),
        F.when(F.col(f"units{i}") > 0, F.round((F.col(f"columns{i}") + F.col(f"combos{i}") + F.col(f"size{i}")) / 3, 1)).alias("total"),
        F.col(f"columns{i}").alias("columns"), F.col(f"combos{i}").alias("combos"), F.col(f"size{i}").alias("unit_size")) for i, r in enumerate(rungs)]
    return means.crossJoin(fits).select(F.explode(F.array(*rung)).alias("r")).select("r.*")  # one row each
