"""Order statistics without a global sort in one task.

Values are counted first, dealt into slices between sampled quantiles, summed
inside each slice by a window and shifted by the slices before it. One task sees
the distinct values of one slice, never all rows, however the values lie.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.tables import written

SLICES, RANK_ERROR = 256, 0.0005


def sliced(values: DataFrame, value: str) -> DataFrame:
    """``values`` with _slice, a number that grows with ``value`` and holds about as many rows as any other."""
    known = values.select(F.col(value).cast("double").alias("_sliced"))
    found = known.approxQuantile("_sliced", [i / SLICES for i in range(1, SLICES)], RANK_ERROR)
    splits = [-math.inf, *(sorted(set(filter(math.isfinite, found))) or [0.0]), math.inf]
    cut = Bucketizer(splits=splits, inputCol="_sliced", outputCol="_slice", handleInvalid="keep")
    return cut.transform(values.withColumn("_sliced", F.col(value).cast("double"))).drop("_sliced")


def cumulative(values: DataFrame, value: str, sums: Sequence[str]) -> DataFrame:
    """``values`` (one row per ``value``) with before_<sum> for each of ``sums``: the sum over smaller values."""
    dealt = sliced(values, value)
    totals = dealt.groupBy("_slice").agg(*[F.sum(s).alias(f"_all_{s}") for s in sums])
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    offsets = totals.select("_slice", *[F.coalesce(F.sum(f"_all_{s}").over(earlier), F.lit(0)).alias(f"_off_{s}") for s in sums])
    inside = Window.partitionBy("_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = dealt.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_in_{s}") for s in sums])
    joined = running.join(F.broadcast(offsets), "_slice")  # at most SLICES rows
    return joined.select(*values.columns, *[(F.col(f"_off_{s}") + F.col(f"_in_{s}")).alias(f"before_{s}") for s in sums])


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> dict[float, float | None]:
    """Exact quantiles with linear interpolation, as a driver-side table of a few numbers."""
    return quantiles_of_counts(df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n")), shares)


def quantiles_of_counts(counted: DataFrame, shares: Sequence[float]) -> dict[float, float | None]:
    """``quantiles`` of the values v of a table (v, n), each there n times."""
    placed = cumulative(counted, "v", ["n"])
    total = counted.agg(F.sum("n")).first()[0] or 0
    if not total:
        return {s: None for s in shares}
    places = {s: s * (total - 1) for s in shares}
    wanted = sorted({int(p) for p in places.values()} | {min(total - 1, int(p) + 1) for p in places.values()})
    hit = [(F.col("before_n") <= w) & (F.col("before_n") + F.col("n") > w) for w in wanted]
    row = placed.agg(*[F.max(F.when(h, F.col("v"))).alias(f"w{i}") for i, h in enumerate(hit)]).first()
    at = {w: row[f"w{i}"] for i, w in enumerate(wanted)}
    out = {}
    for s, p in places.items():
        low = int(p)
        a, b = at[low], at[min(total - 1, low + 1)]
        out[s] = a + (b - a) * (p - low)
    return out


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each of ``columns`` replaced by its rank, ties sharing their mean rank.

    Values are counted in ``df`` itself, once a column, and ranks are written tables: those of few values
    are known to be small, so that rows are not exchanged for them.
    """
    ranked = df
    for c in columns:
        counted = written(df.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_n")), "values")
        ranks = written(cumulative(counted, "_v", ["_n"]).select("_v", (F.col("before__n") + (F.col("_n") + 1) / 2).alias("_rank")), "ranks")
        ranked = ranked.join(ranks, F.col(c) == F.col("_v")).drop(c, "_v").withColumnRenamed("_rank", c)
    return ranked


def ks_statistic(original: DataFrame, reduced: DataFrame, value: Column) -> DataFrame:
    """One row (ks): the largest gap between the two unweighted distribution functions; null if a side is empty."""
    return ks_of_counts(*[df.groupBy(value.cast("double").alias("v")).agg(F.count("*").alias("n")) for df in (original, reduced)])


def ks_of_counts(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """``ks_statistic`` of two tables (v, n) of values and their numbers."""
    both = original.select("v", F.col("n").alias("o"), F.lit(0).alias("r")).union(reduced.select("v", F.lit(0).alias("o"), F.col("n").alias("r")))
    counted = both.filter(F.col("v").isNotNull()).groupBy("v").agg(F.sum("o").alias("o"), F.sum("r").alias("r"))
    placed = cumulative(counted, "v", ["o", "r"])
    whole = counted.agg(F.sum("o").alias("all_o"), F.sum("r").alias("all_r"))
    upto_o, upto_r = F.col("before_o") + F.col("o"), F.col("before_r") + F.col("r")
    gap = F.abs(F.try_divide(upto_o.cast("double"), F.col("all_o")) - F.try_divide(upto_r.cast("double"), F.col("all_r")))
    return placed.crossJoin(F.broadcast(whole)).agg(F.max(gap).alias("ks"))  # ``whole`` is one row
