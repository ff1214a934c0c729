"""How faithful a weighted reduction is: distributions and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial, reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.expressions import js_distance, js_term, level
from tarn.functions.tables import together
from tarn.operators.concordance import kendall
from tarn.operators.features import is_numeric, number
from tarn.operators.ordered import average_ranks, ks_of_counts

TINY = 1e-9
METRIC = "name string, kind string, score double, detail map<string,double>"


def moments(df: DataFrame, value: Column, weight: Column) -> DataFrame:
    """One row (mean, std): weighted mean and population deviation, from values shifted by their plain mean."""
    shift = df.agg(F.avg(value)).first()[0] or 0.0
    moved = value - F.lit(shift)
    there = df.filter(value.isNotNull())
    sums = there.agg(F.sum(weight).alias("w"), F.sum(weight * moved).alias("wx"), F.sum(weight * moved * moved).alias("wxx"))
    mean = F.col("wx") / F.col("w")
    return sums.select((F.lit(shift) + mean).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("wxx") / F.col("w") - mean * mean)).alias("std"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, n): how often each value of a column occurs, numbers as numbers, others as levels."""
    value = number(column) if is_numeric(df, column) else level(column)
    return df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))


def numeric_score(original: DataFrame, reduced: DataFrame, column: str, counted: DataFrame | None = None) -> DataFrame:
    """One row (score, mean_diff_ratio, std_diff_ratio, ks); ``reduced`` has _weight. An empty side scores 0.

    ``counted`` holds the original's ``value_counts`` where they are known.
    """
    counted = value_counts(original, column) if counted is None else counted
    o = moments(counted, F.col("v"), F.col("n")).select(F.col("mean").alias("mo"), F.col("std").alias("so"))
    r = moments(reduced, number(column), F.col("_weight")).select(F.col("mean").alias("mr"), F.col("std").alias("sr"))
    ks = ks_of_counts(counted, value_counts(reduced, column))
    rows = o.crossJoin(r).crossJoin(ks)  # one row each
    scale = F.when(F.abs("mo") > TINY, F.abs("mo")).otherwise(1.0)
    spread = F.when(F.col("so") > TINY, F.col("so")).otherwise(1.0)
    rows = rows.withColumns({"dm": F.abs(F.col("mr") - F.col("mo")) / scale, "ds": F.abs(F.col("sr") - F.col("so")) / spread})
    off = 0.5 * F.col("ks") + 0.25 * F.least("dm", F.lit(1.0)) + 0.25 * F.least("ds", F.lit(1.0))
    return rows.select(
        F.coalesce(F.round(100 * (1 - F.least(F.lit(1.0), off)), 1), F.lit(0.0)).alias("score"),
        F.round("dm", 4).alias("mean_diff_ratio"),
        F.round("ds", 4).alias("std_diff_ratio"),
        F.round("ks", 4).alias("ks"),
    )


def level_shares(original: DataFrame, reduced: DataFrame, key: Column, counted: DataFrame | None = None) -> DataFrame:
    """(value, p, q) over the levels of either side; q is weighted by _weight. ``counted``: the original's ``value_counts``."""
    p = counted.select(F.col("v").alias("value"), F.col("n").cast("double").alias("n")) if counted is not None else original.groupBy(key.alias("value")).agg(F.count("*").cast("double").alias("n"))
    q = reduced.groupBy(key.alias("value")).agg(F.sum("_weight").alias("w"))
    both = p.join(q, "value", "full_outer")
    sums = both.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    shares = both.crossJoin(F.broadcast(sums))  # one row
    return shares.select("value", F.coalesce(F.col("n") / F.col("all_n"), F.lit(0.0)).alias("p"), F.coalesce(F.try_divide("w", "all_w"), F.lit(0.0)).alias("q"))


def divergence(shares: DataFrame) -> DataFrame:
    """One row (js, max_gap, levels, coverage) for (value, p, q)."""
    return shares.agg(
        js_distance(F.sum(js_term(F.col("p"), F.col("q")))).alias("js"),
        F.max(F.abs(F.col("p") - F.col("q"))).alias("max_gap"),
        F.count("*").alias("levels"),
        F.avg((F.col("q") > 0).cast("int")).alias("coverage"),
    )


def categorical_score(original: DataFrame, reduced: DataFrame, column: str, counted: DataFrame | None = None) -> DataFrame:
    """One row (score, js_divergence, max_ratio_gap, levels)."""
    d = divergence(level_shares(original, reduced, level(column), counted))
    off = 0.7 * F.col("js") + 0.3 * F.col("max_gap")
    return d.select(
        F.round(100 * (1 - F.least(F.lit(1.0), off)), 1).alias("score"),
        F.round("js", 4).alias("js_divergence"),
        F.round("max_gap", 4).alias("max_ratio_gap"),
        "levels",
    )


def column_metrics(original: DataFrame, reduced: DataFrame, columns: Sequence[str], counted: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """(name, kind, score, detail), one row per column; ``counted`` holds the original's ``value_counts`` of columns."""

    def row(c: str) -> DataFrame:
        known = (counted or {}).get(c)
        if is_numeric(original, c):
            s, kind, names = numeric_score(original, reduced, c, known), "numeric", ("mean_diff_ratio", "std_diff_ratio", "ks")
        else:
            s, kind, names = categorical_score(original, reduced, c, known), "categorical", ("js_divergence", "max_ratio_gap", "levels")
        detail = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))])
        return s.select(F.lit(c).alias("name"), F.lit(kind).alias("kind"), "score", detail.alias("detail"))

    rows = together([partial(row, c) for c in columns])
    return reduce(DataFrame.unionByName, rows) if rows else original.sparkSession.createDataFrame([], METRIC)


def distribution_score(metrics: DataFrame) -> DataFrame:
    """One row (score): the mean column score; 0 without columns."""
    return metrics.agg(F.coalesce(F.round(F.avg("score"), 1), F.lit(0.0)).alias("score"))


def pearson(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) per pair in one aggregation; a pair with a constant column has r = 0."""
    parts = []
    for i, (a, b) in enumerate(pairs):
        x, y = number(a), number(b)
        there = x.isNotNull() & y.isNotNull()
        flat = (F.stddev_pop(F.when(there, x)) == 0) | (F.stddev_pop(F.when(there, y)) == 0)
        # Dividing by the product of the deviations is left to corr, which fails on constants.
        parts += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(F.when(there, x)).alias(f"x{i}"), F.stddev_pop(F.when(there, y)).alias(f"y{i}"), flat.alias(f"f{i}")]
    row = df.agg(*parts)
    r = lambda i: F.when(F.coalesce(F.col(f"f{i}"), F.lit(True)), 0.0).otherwise(F.try_divide(F.col(f"c{i}"), F.col(f"x{i}") * F.col(f"y{i}")))
    made = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), r(i).alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(made).alias("p")).select("p.*")


def correlation_edges(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) for every pair of columns, Pearson, Spearman or Kendall, unweighted."""
    if method not in ("pearson", "spearman", "kendall"):
        raise ValueError(f"unknown method: {method}")
    if method == "kendall":
        return kendall(df, columns)
    own = df.select(*[number(c).alias(c) for c in columns])
    if method == "spearman":
        own = average_ranks(own.dropna(), columns)
    return pearson(own, list(combinations(columns, 2)))


def edge_changes(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """(a, b, r_o, r_r) of two edge lists."""
    return original.select("a", "b", F.col("r").alias("r_o")).join(reduced.select("a", "b", F.col("r").alias("r_r")), ["a", "b"])


def correlation_preservation(changes: DataFrame) -> DataFrame:
    """One row (score, frobenius, mean_gap, max_gap, corr_of_corr) for (a, b, r_o, r_r)."""
    gap = F.abs(F.col("r_o") - F.col("r_r"))
    sums = changes.agg(
        F.count("*").alias("n"),
        F.avg(gap).alias("mean"),
        F.max(gap).alias("most"),
        F.sqrt(2 * F.sum(gap * gap)).alias("frobenius"),
        F.covar_pop("r_o", "r_r").alias("c"),
        F.stddev_pop("r_o").alias("x"),
        F.stddev_pop("r_r").alias("y"),
    )
    off = 0.6 * F.col("mean") + 0.4 * F.col("most")
    return sums.select(
        F.coalesce(F.round(100 * (1 - F.least(F.lit(1.0), off)), 1), F.lit(100.0)).alias("score"),
        F.round("frobenius", 4).alias("frobenius"),
        F.round("mean", 4).alias("mean_gap"),
        F.round("most", 4).alias("max_gap"),
        F.when(F.col("n") == 1, 1.0).otherwise(F.round(F.try_divide(F.col("c"), F.col("x") * F.col("y")), 4)).alias("corr_of_corr"),
    )
