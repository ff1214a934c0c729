"""The data behind comparison charts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.expressions import level
from tarn.operators.catfidelity import distribution_table
from tarn.operators.drawing import subsample
from tarn.operators.fidelity import level_shares
from tarn.operators.ordered import quantiles

SCATTER_ROWS, BINS, BARS = 20_000, 39, 12


def axes_of(df: DataFrame, width: int, components: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of ``features`` from one pass over all rows: each task gives its sums of products."""
    origin = np.array(df.select("features").first().features, float)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            # Of a point near all others, so that little is lost in the sums.
            points = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(batch), width) - origin
            points = np.hstack([points, np.ones((len(points), 1))])
            total += points.T @ points
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "value"])

    sums = df.select(F.col("features").cast("array<double>")).mapInArrow(task, "at long, value double").groupBy("at").agg(F.sum("value").alias("value"))
    total = np.zeros((width + 1) ** 2)
    for r in sums.collect():  # (width + 1) squared rows
        total[r.at] = r.value
    total = total.reshape(width + 1, width + 1)
    rows = total[width, width]
    mean = total[width, :width] / rows
    _, vectors = np.linalg.eigh(total[:width, :width] / rows - np.outer(mean, mean))
    # Of the two directions of an axis, that in which its largest part is positive.
    axes = vectors[:, ::-1][:, :components].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return mean + origin, axes


def scatter(df: DataFrame, reduced: DataFrame, key: Sequence[str], seed: int = 0, components: int = 2, limit: int = SCATTER_ROWS) -> DataFrame:
    """(side, pc1, pc2[, ...], size): a draw of the original and all representatives on the original's axes."""
    width = len(df.select("features").first().features)
    mean, axes = axes_of(df, width, components)
    pc = [sum(((F.col("features")[i] - F.lit(float(mean[i]))) * F.lit(float(a[i])) for i in range(width)), F.lit(0.0)).alias(f"pc{n + 1}") for n, a in enumerate(axes)]
    o = subsample(df, limit, key, seed).select(F.lit("original").alias("side"), *pc, F.lit(2.0).alias("size"))
    scale = reduced.agg(F.avg("_weight")).first()[0] or 1.0
    return o.union(reduced.select(F.lit("reduced").alias("side"), *pc, point_size(F.col("_weight"), scale).alias("size")))


def pair_scatter(original: DataFrame, reduced: DataFrame, pair: tuple[str, str], key: Sequence[str], seed: int = 0, limit: int = SCATTER_ROWS) -> DataFrame:
    """(side, x, y, size) of one pair of columns: a draw of the original beside all representatives; rows without a value are left out."""
    x, y = (F.col(c).cast("double") for c in pair)
    there = x.isNotNull() & y.isNotNull()
    scale = reduced.agg(F.avg("_weight")).first()[0] or 1.0
    o = subsample(original.filter(there), limit, key, seed).select(F.lit("original").alias("side"), x.alias("x"), y.alias("y"), F.lit(2.0).alias("size"))
    return o.union(reduced.filter(there).select(F.lit("reduced").alias("side"), x.alias("x"), y.alias("y"), point_size(F.col("_weight"), scale).alias("size")))


def box_plots(original: DataFrame, reduced: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, side, least, low, q1, median, q3, high, most): quartiles, and whiskers within 1.5 times their distance."""
    rows = []
    for c in columns:
        for side, df in (("original", original), ("reduced", reduced)):
            q = quantiles(df, c, [0.25, 0.5, 0.75])
            reach = 1.5 * ((q[0.75] or 0.0) - (q[0.25] or 0.0))
            value = F.col(c).cast("double")
            inside = value.between((q[0.25] or 0.0) - reach, (q[0.75] or 0.0) + reach)
            ends = df.agg(F.min(value).alias("least"), F.min(F.when(inside, value)).alias("low"), F.max(F.when(inside, value)).alias("high"), F.max(value).alias("most"))
            middle = [F.lit(q[s]).cast("double").alias(n) for s, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
            rows.append(ends.select(F.lit(c).alias("column"), F.lit(side).alias("side"), "least", "low", *middle, "high", "most"))
    return reduce(DataFrame.unionByName, rows)


def point_size(weight: Column, mean: float) -> Column:
    return F.least(F.lit(40.0), F.greatest(F.lit(2.0), 6 * weight / F.lit(mean)))


def histogram(original: DataFrame, reduced: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, original, reduced): densities between the 0.1 % and 99.9 % quantiles of the original."""
    ends = quantiles(original, column, [0.001, 0.999])
    low, high = ends[0.001] or 0.0, ends[0.999] or 0.0
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("int")

    def counted(df: DataFrame, weight: Column, name: str) -> DataFrame:
        inside = df.filter(F.col(column).between(low, high)).select(at.alias("bin"), weight.alias("w"))
        sums = inside.groupBy("bin").agg(F.sum("w").alias("w"))
        total = F.sum("w").over(Window.partitionBy(F.lit(0)))  # at most ``bins`` rows
        return sums.select("bin", (F.col("w") / total / F.lit(width)).alias(name))

    grid = original.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = grid.join(counted(original, F.lit(1.0), "original"), "bin", "left").join(counted(reduced, F.col("_weight"), "reduced"), "bin", "left")
    return out.na.fill(0.0, ["original", "reduced"]).select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(low) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "original", "reduced")


def category_bars(original: DataFrame, reduced: DataFrame, column: str, top: int = BARS) -> DataFrame:
    """(value, p, q) of the commonest values of the original."""
    return level_shares(original, reduced, level(column)).filter(F.col("p") > 0).orderBy(F.desc("p"), "value").limit(top)


def distribution_panels(original: DataFrame, reduced: DataFrame, columns: Sequence[str], panels: int = 6, values: int = BARS) -> DataFrame:
    """The distribution table of the first ``panels`` columns, with each column's largest gap."""
    if not columns:
        raise ValueError("nothing to plot")
    table = distribution_table(original, reduced, columns[:panels], values)
    return table.withColumn("max_gap_pp", F.max(F.abs("gap_pp")).over(Window.partitionBy("column")))


def unit_sizes(units: DataFrame) -> DataFrame:
    """(rows, density): the share of units of each size."""
    counts = units.groupBy("rows").agg(F.count("*").alias("n"))
    return counts.select("rows", (F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0)))).alias("density"))
