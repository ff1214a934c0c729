"""Kendall's tau-b of all pairs of columns from counts of inversions, without pairs of rows.

Each column is cut at sampled quantiles into slices; a value at a cut is a slice
of its own, so that a frequent value never fills the slice of others. Two rows
in the other order by one column than by another are told apart by where they lie:
in different slices of both columns (counted from the slices' common sizes), in one
slice of the first, or in different ones of the first and one of the second
(counted in each slice, by bits of the ranks). A task holds one slice.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.tables import written
from tarn.operators.features import number
from tarn.operators.ordered import RANK_ERROR, SLICES

SLICE_ROWS = 20_000


def inversions(rank: np.ndarray) -> int:
    """Pairs in which a larger number stands before a smaller one: for each bit, ones before zeros among equals in the higher bits."""
    rank = np.unique(rank, return_inverse=True)[1]
    total, order = 0, np.arange(len(rank))
    for bit in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        high, one = rank[order] >> (bit + 1), (rank[order] >> bit) & 1
        ones = np.cumsum(one)
        first = np.searchsorted(high, high)
        total += int(((ones - one) - (ones - one)[first])[one == 0].sum())
        # Stable, so that equals in the bits so far keep their order.
        order = order[np.argsort(rank[order] >> bit, kind="stable")]
    return total


def cut_slices(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with s0, s1, ... for its columns: 2b for a value at cut b, 2b + 1 for one between the cuts b and b + 1."""
    parts = int(min(SLICES, -(-df.count() // SLICE_ROWS)))
    shares = [i / parts for i in range(1, parts)]
    found = df.approxQuantile(list(columns), shares, RANK_ERROR) if shares else [[] for _ in columns]
    for i, (c, cuts) in enumerate(zip(columns, found, strict=True)):
        cuts = sorted(set(filter(math.isfinite, cuts))) or [0.0]
        # NaN cannot occur, null is kept.
        df = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=c, outputCol="_bucket", handleInvalid="keep").transform(df)
        bucket = F.col("_bucket").cast("int")
        at_cut = (bucket > 0) & (F.try_element_at(F.array(*[F.lit(x) for x in cuts]), bucket) == F.col(c))
        df = df.withColumn(f"s{i}", F.when(at_cut, 2 * bucket).otherwise(2 * bucket + 1)).drop("_bucket")
    return df


def _crossed(cells: Sequence[tuple[int, int, int]]) -> int:
    """Pairs of rows in different slices of both columns, in the other order."""
    width = [max(c[i] for c in cells) + 1 for i in (0, 1)]
    count = np.zeros(width, object)
    for a, b, n in cells:
        count[a, b] = n
    before = np.cumsum(count, axis=0) - count
    # Of the rows in earlier slices of the first column, those in later ones of the second.
    later = np.cumsum(before[:, ::-1], axis=1)[:, ::-1] - before
    return int((count * later).sum())


def kendall(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, r): tau-b of each pair of columns over the rows that have both values; 0 where one is constant.

    An empty table gives r = 0. NaN counts as missing.
    """
    own = df.select(*[F.when(~F.isnan(number(c)), number(c)).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    own = own.select(*[(F.col(c) + 0.0).alias(c) for c in own.columns])  # one zero
    cut = cut_slices(own, own.columns)
    pairs = list(combinations(range(len(columns)), 2))
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pair"), F.col(f"v{i}").alias("x"), F.col(f"v{j}").alias("y"), F.col(f"s{i}").alias("sx"), F.col(f"s{j}").alias("sy")) for p, (i, j) in enumerate(pairs)]))
    rows = written(cut.select(each.alias("p")).select("p.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull()), "concordance")

    def inside(f: pd.DataFrame) -> pd.DataFrame:
        # Rows of one slice of x, by x; of equal x by y, which is no inversion.
        f = f.sort_values(["x", "y"])
        return pd.DataFrame({"pair": f["pair"].iloc[:1], "n": [inversions(f["y"].to_numpy())]})

    def across(f: pd.DataFrame) -> pd.DataFrame:
        # Rows of one slice of y, by the slice of x; those of one slice were counted before.
        f = f.sort_values(["sx", "y"])
        return pd.DataFrame({"pair": f["pair"].iloc[:1], "n": [inversions(f["y"].to_numpy())]})

    # Slices of one value, with even numbers, hold no inversions.
    found = rows.filter("sx % 2 = 1").groupBy("pair", "sx").applyInPandas(inside, "pair int, n long")
    found = found.union(rows.filter("sy % 2 = 1").groupBy("pair", "sy").applyInPandas(across, "pair int, n long"))
    discordant = {r.pair: int(r.n) for r in found.groupBy("pair").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()}
    cells: dict[int, list[tuple[int, int, int]]] = {}
    for r in rows.groupBy("pair", "sx", "sy").count().collect():  # at most (2 SLICES) squared a pair
        cells.setdefault(r.pair, []).append((r.sx, r.sy, r["count"]))
    ties: dict[tuple[int, int], int] = {}
    twice = (F.col("n") * (F.col("n") - 1)).cast("decimal(38,0)")
    for kind, by in enumerate((["x"], ["y"], ["x", "y"])):
        counted = rows.groupBy("pair", *by).agg(F.count("*").cast("decimal(18,0)").alias("n"))
        ties |= {(r.pair, kind): int(r.t) for r in counted.groupBy("pair").agg(F.sum(twice).alias("t")).collect()}
    out = []
    for p, (i, j) in enumerate(pairs):
        n = sum(c[2] for c in cells.get(p, []))
        both = n * (n - 1)
        x, y, joint = (ties.get((p, kind), 0) for kind in range(3))
        apart = discordant.get(p, 0) + (_crossed(cells[p]) if p in cells else 0)
        scale = ((both - x) * (both - y)) ** 0.5
        out.append((columns[i], columns[j], (both - x - y + joint - 4 * apart) / scale if scale else 0.0))
    return df.sparkSession.createDataFrame(out, "a string, b string, r double")
