"""Stratification: choice of a column, proportional allocation, stratified draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarn.functions.expressions import level
from tarn.operators.drawing import check_size, smallest_of_groups

LEVELS = (2, 50)  # fixed values: fewest and most levels of a stratification column


def entropies(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(at, column, levels, entropy in nats) for categorical columns; a null is a level."""
    stacked = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), level(c).alias("value")) for i, c in enumerate(columns)])).alias("s")).select("s.*")
    counts = stacked.groupBy("at", "column", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("at", "column").agg(F.sum("n").alias("all"), F.count("*").alias("levels"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"))
    # -sum(p ln p) with p = n / all
    return totals.select("at", "column", "levels", (F.ln("all") - F.col("nlogn") / F.col("all")).alias("entropy"))


def choose_column(df: DataFrame, columns: Sequence[str]) -> str | None:
    """The categorical column of 2 to 50 levels with the highest entropy; the first wins ties."""
    if not columns:
        return None
    found = entropies(df, columns).filter(F.col("levels").between(*LEVELS)).withColumn("entropy", F.round("entropy", 12)).orderBy(F.desc("entropy"), "at").first()
    return found["column"] if found else None


def allocate(sizes: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """``sizes`` (with size) plus raw and alloc: n shared in proportion, at least 1 and at most size each.

    What rounding leaves is given to the largest remainders; what minimums take
    too much is taken back, one at a time, where most was given beyond the share.
    Ties go by ``order``. The sum is n unless there are more strata than n.
    """
    whole = Window.partitionBy(F.lit(0))
    first = sizes.withColumn("raw", F.col("size") * F.lit(float(n)) / F.sum("size").over(whole))
    first = first.withColumn("alloc", F.least(F.col("size").cast("long"), F.greatest(F.lit(1), F.floor("raw"))))
    first = first.withColumn("_spare", F.lit(n) - F.sum("alloc").over(whole)).withColumn("_at", F.row_number().over(whole.orderBy(*order)))
    room = F.col("size") > F.col("alloc")
    gain = F.row_number().over(whole.orderBy(F.when(room, 0).otherwise(1), F.desc(F.col("raw") - F.col("alloc")), "_at"))
    grown = first.withColumn("_gain", F.when(room & (gain <= F.col("_spare")), 1).otherwise(0))
    steps = first.filter((F.col("_spare") < 0) & (F.col("alloc") > 1)).select("_at", "_spare", F.explode(F.sequence(F.lit(0), F.col("alloc") - 2)).alias("j"), (F.col("alloc") - F.col("raw")).alias("over"))
    taken = steps.withColumn("_turn", F.row_number().over(whole.orderBy(F.desc(F.col("over") - F.col("j")), "_at"))).filter(F.col("_turn") <= -F.col("_spare"))
    loss = taken.groupBy("_at").agg(F.count("*").alias("_loss"))
    return grown.join(loss, "_at", "left").withColumn("alloc", F.col("alloc") + F.col("_gain") - F.coalesce("_loss", F.lit(0))).drop("_at", "_spare", "_gain", "_loss")


def stratified_sample(df: DataFrame, n: int, column: str, key: Sequence[str], seed: int = 0) -> DataFrame:
    """About n rows that keep the shares of ``column``; _weight is stratum size over rows taken."""
    n = check_size(n, df.count())
    levelled = df.withColumn("_stratum", level(column))
    sizes = levelled.groupBy("_stratum").agg(F.count("*").alias("size"))
    takes = allocate(sizes, n, ["_stratum"]).select("_stratum", F.col("alloc").alias("_take"), (F.col("size") / F.col("alloc")).alias("_weight"))
    return smallest_of_groups(levelled, ["_stratum"], takes, key, seed).select(*df.columns, "_weight")
