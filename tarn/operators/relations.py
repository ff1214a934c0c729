"""Relations between columns before and after reduction, and how clusters are reflected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.tables import written

EDGE, WEAKER = 0.3, 0.1


def network(edges: DataFrame, threshold: float = EDGE) -> DataFrame:
    """(a, b, r, sign, width) of relations at or above ``threshold``."""
    strong = edges.filter(F.abs("r") >= threshold)
    return strong.select("a", "b", "r", F.when(F.col("r") < 0, "negative").otherwise("positive").alias("sign"), F.abs("r").alias("width"))


def outcomes(changes: DataFrame, threshold: float = EDGE, margin: float = WEAKER) -> DataFrame:
    """(a, b, r_o, r_r, gap, outcome) for relations strong on either side, largest change first."""
    was, now = F.abs("r_o") >= threshold, F.abs("r_r") >= threshold
    outcome = (
        F.when(was & ~now, "vanished")
        .when(~was & now, "new")
        .when(F.abs("r_r") < F.abs("r_o") - margin, "weaker")
        .when(F.abs("r_r") > F.abs("r_o") + margin, "stronger")
        .otherwise("kept")
    )
    gap = F.abs(F.col("r_o") - F.col("r_r"))
    return changes.filter(was | now).select("a", "b", "r_o", "r_r", gap.alias("gap"), outcome.alias("outcome")).orderBy(F.desc("gap"), "a", "b")


def vanished_and_new(original: DataFrame, reduced: DataFrame, threshold: float = EDGE) -> DataFrame:
    """(a, b, status) of relations that stand on one side alone."""
    o = network(original, threshold).select("a", "b", F.lit(1).alias("o"))
    r = network(reduced, threshold).select("a", "b", F.lit(1).alias("n"))
    both = o.join(r, ["a", "b"], "full_outer")
    return both.filter(F.col("o").isNull() | F.col("n").isNull()).select("a", "b", F.when(F.col("n").isNull(), "vanished").otherwise("new").alias("status"))


def ranked_changes(changes: DataFrame) -> DataFrame:
    """Pairs by the size of their change."""
    return changes.withColumn("gap", F.abs(F.col("r_o") - F.col("r_r"))).orderBy(F.desc("gap"), "a", "b")


def difference_matrix(changes: DataFrame) -> DataFrame:
    """One row per column with the change of its relation to every other column; 0 on the diagonal."""
    gap = written(changes.select("a", "b", (F.col("r_r") - F.col("r_o")).alias("d")), "changes")  # a row a pair, of two passes over the tables
    both = gap.union(gap.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    names = sorted({r.a for r in both.select("a").distinct().collect()})  # column names
    return both.groupBy("a").pivot("b", names).agg(F.first("d")).na.fill(0.0).withColumnRenamed("a", "name")


def cluster_reflection(original: DataFrame, reduced: DataFrame, cluster: str, floor: int = 30) -> DataFrame:
    """Per cluster: rows and shares on both sides, and whether it is reflected, by its minimum, or not."""
    o = original.groupBy(cluster).agg(F.count("*").alias("orig_rows"))
    r = reduced.groupBy(cluster).agg(F.count("*").alias("reduced_rows"))
    both = o.join(r, cluster, "left").na.fill(0, ["reduced_rows"])
    sums = both.agg(F.sum("orig_rows").alias("all_o"), F.greatest(F.sum("reduced_rows"), F.lit(1)).alias("all_r"))
    rated = both.crossJoin(F.broadcast(sums))  # one row
    least = F.least(F.lit(floor), F.col("orig_rows"))
    status = F.when(F.col("reduced_rows") == 0, "not reflected").when(F.col("reduced_rows") <= least, "by minimum guarantee").otherwise("reflected")
    return rated.select(cluster, "orig_rows", "reduced_rows", (F.col("orig_rows") / F.col("all_o")).alias("orig_ratio"), (F.col("reduced_rows") / F.col("all_r")).alias("reduced_ratio"), status.alias("status"))


def scale_comparison(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """One row: rows before and after, and rows that a representative stands for."""
    n, m = original.agg(F.count("*").alias("orig_rows")), reduced.agg(F.count("*").alias("reduced_rows"), F.avg("_weight").alias("mean_weight"), F.max("_weight").alias("max_weight"))
    return n.crossJoin(m)  # one row each


def causes(changes: DataFrame, without_outliers: DataFrame, threshold: float = EDGE, margin: float = WEAKER, border: float = 0.05) -> DataFrame:
    """(a, b, outcome, cause) of changed relations: outliers left out, closeness to the threshold, or the representatives."""
    clean = without_outliers.select("a", "b", F.col("r").alias("r_clean"))
    joined = outcomes(changes, threshold, margin).filter(F.col("outcome") != "kept").join(clean, ["a", "b"])
    outliers = F.abs(F.col("r_o") - F.col("r_clean")) >= 0.5 * F.col("gap")
    near = (F.abs(F.abs("r_o") - threshold) <= border) & F.col("outcome").isin("vanished", "new")
    return joined.select("a", "b", "outcome", F.when(outliers, "outliers left out").when(near, "near the threshold").otherwise("representatives").alias("cause"))
