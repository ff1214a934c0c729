"""Exact-size draws: the rows with the smallest digests of each group.

Only digests are counted, by their first characters, until the characters that
the last drawn row begins with hold few rows. Rows below them are taken by a
filter; only the few rows that begin with them are ranked. Rows that are not
drawn are neither exchanged nor sorted, and groups of any size stay spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.expressions import composite_key, digest
from tarn.functions.tables import written

PREFIX, DIGEST = 3, 32  # hexadecimal characters: 4096 slices a step
EDGE_ROWS = 50_000  # rows that share the last drawn row's characters, at most, unless their digests are equal


def drawn_by(df: DataFrame, key: Sequence[str], seed: int) -> Column:
    """The digest that orders the rows of a draw."""
    return digest(composite_key(df, list(key)), seed)


def placed(df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int) -> DataFrame:
    """``df`` with _place, from 1: each row's place in its group by digest, ties by key. For narrow tables: all rows are ranked."""
    drawn = df.withColumn("_key", composite_key(df, list(key))).withColumn("_digest", digest(F.col("_key"), seed))
    drawn = drawn.withColumn("_slice", F.substring("_digest", 1, PREFIX))
    earlier = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn.groupBy(*groups, "_slice").agg(F.count("*").alias("_n"))
    offsets = counts.select(*[F.col(g).alias(f"_of_{g}") for g in groups], F.col("_slice").alias("_of_slice"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    same = F.col("_slice") == F.col("_of_slice")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    inside = Window.partitionBy(*groups, "_slice").orderBy("_digest", "_key")
    ranked = drawn.withColumn("_rank", F.row_number().over(inside)).join(offsets, same)
    return ranked.withColumn("_place", F.col("_before") + F.col("_rank")).select(*df.columns, "_place")


def check_size(n: int, total: int) -> int:
    """The size of a draw: at least 1, at most ``total``."""
    if n <= 0:
        raise ValueError("the reduced size must be at least 1")
    return min(n, total)


def smallest(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> tuple[DataFrame, int]:
    """The ``n`` rows of smallest digest (all, if fewer; ties by key), and how many rows there are."""
    own = drawn_by(df, key, seed)
    digests = df.select(own.alias("_digest"))
    prefix, rest, total = "", n, None
    while True:
        length = len(prefix) + PREFIX
        inside = digests.filter(F.col("_digest").startswith(prefix)) if prefix else digests
        counts = inside.groupBy(F.substring("_digest", 1, length).alias("p")).count().orderBy("p").collect()  # 4096 rows at most
        if total is None and rest >= (total := sum(r["count"] for r in counts)):
            return df, total
        for r in counts:
            if r["count"] >= rest:
                break
            rest -= r["count"]
        prefix = r.p
        if r["count"] <= EDGE_ROWS or length + PREFIX > DIGEST:
            break
    below = df.filter(own < F.lit(prefix))
    edge = df.filter(own.startswith(prefix)).withColumns({"_digest": own, "_key": composite_key(df, list(key))})
    return below.union(edge.orderBy("_digest", "_key").limit(rest).select(*df.columns)), total


def few_smallest(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """``smallest`` for few rows of a persisted table, in one pass over it: somewhat more than ``n`` rows are written, and ``n`` taken of them.

    Digests lie evenly, so that a bound for about that many is known beforehand; where it leaves too few, ``smallest`` draws.
    """
    total, reach = df.count(), n + 6 * math.sqrt(n) + 64
    if reach < total:
        drawn = df.withColumns({"_digest": drawn_by(df, key, seed), "_key": composite_key(df, list(key))})
        near = written(drawn.filter(F.col("_digest") < F.lit(f"{int(reach / total * 16**12):012x}")), "draw")
        if near.count() >= n:
            return near.orderBy("_digest", "_key").limit(n).select(*df.columns)
    return smallest(df, n, key, seed)[0]


def smallest_of_groups(df: DataFrame, groups: Sequence[str], takes: DataFrame, key: Sequence[str], seed: int = 0, once: bool = False) -> DataFrame:
    """The rows of smallest digest of each group, as many as its row of ``takes`` (groups, _take) says; its other columns come along.

    ``once`` is for few rows: they are written in one pass, and ranked there.
    """
    own, named = drawn_by(df, key, seed), [f"_of_{g}" for g in groups]
    carried = [c for c in takes.columns if c not in (*groups, "_take")]
    digests = df.select(*[F.col(g).alias(n) for g, n in zip(groups, named, strict=True)], own.alias("_digest"))
    edges = takes.select(*[F.col(g).alias(n) for g, n in zip(groups, named, strict=True)], *carried, F.col("_take").cast("long").alias("_rest"), F.lit("").alias("_prefix"))
    by = Window.partitionBy(*named)
    running = by.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)

    def same(names: Sequence[str]) -> Column:
        on = F.lit(True)
        for a, b in zip(names, named, strict=True):
            on = on & F.col(a).eqNullSafe(F.col(b))
        return on

    own_names = [f"_own{n}" for n in named]
    digests = digests.withColumnsRenamed(dict(zip(named, own_names, strict=True)))
    held = None
    for length in range(PREFIX, DIGEST, PREFIX):
        if length == PREFIX:
            # All rows take part: they are counted before they meet the groups' sizes.
            counts = digests.groupBy(*own_names, F.substring("_digest", 1, length).alias("p")).agg(F.count("*").alias("_n"))
            counts = counts.join(edges, same(own_names)).select(*named, *carried, "_rest", "p", "_n")
        else:
            inside = digests.join(edges, same(own_names) & F.col("_digest").startswith(F.col("_prefix")))
            counts = inside.groupBy(*named, *carried, "_rest", F.substring("_digest", 1, length).alias("p")).agg(F.count("*").alias("_n"))
        counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(running), F.lit(0)), "_whole": F.sum("_n").over(by)})
        upto = F.col("_before") + F.col("_n")
        # The slice of the last drawn row; the group's last slice if all of it is drawn.
        reached = counts.filter((F.col("_before") < F.col("_rest")) & ((upto >= F.col("_rest")) | (upto == F.col("_whole"))))
        edges = reached.select(*named, *carried, (F.col("_rest") - F.col("_before")).alias("_rest"), F.col("p").alias("_prefix"), "_n").persist()
        if held is not None:
            held.unpersist()
        held = edges
        if (edges.agg(F.max("_n")).first()[0] or 0) <= EDGE_ROWS:
            break
        edges = edges.drop("_n")
    met = df.withColumns({"_digest": own, "_key": composite_key(df, list(key))}).join(edges, same(groups))
    met = met.filter(F.substring("_digest", F.lit(1), F.length("_prefix")) <= F.col("_prefix"))
    if once:
        met = written(met, "draw")
    below = ~F.col("_digest").startswith(F.col("_prefix"))
    place = F.row_number().over(Window.partitionBy(*named).orderBy("_digest", "_key"))
    ranked = met.filter(~below).withColumn("_place", place).filter(F.col("_place") <= F.col("_rest"))
    return met.filter(below).select(*df.columns, *carried).union(ranked.select(*df.columns, *carried))


def random_sample(df: DataFrame, n: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly min(n, rows) rows without replacement, each with _weight = rows / n."""
    check_size(n, n)
    drawn, total = smallest(df, n, key, seed)
    return drawn.withColumn("_weight", F.lit(total / min(n, total) if total else 0.0))


def subsample(df: DataFrame, limit: int, key: Sequence[str], seed: int = 0) -> DataFrame:
    """At most ``limit`` rows, drawn uniformly; smaller tables stay whole."""
    return smallest(df, limit, key, seed)[0]
