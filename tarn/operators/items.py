"""Items with needs and measures: those that are ready, and sums by nested columns with their total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ready_items(df: DataFrame, key: Sequence[str], done: Column, needs: Column) -> DataFrame:
    """Keys of the items that are not done while all that they need is.

    ``needs`` is an array of structs with the fields of ``key``. Rows of one key are one
    item: done if all of its rows are, with the needs of all of them. A need that
    names no item is never done; an item without needs is ready; keys with nulls are no items.
    """
    rows = df.select(*key, F.coalesce(done, F.lit(False)).alias("_done"), needs.alias("_needs")).dropna(subset=list(key))
    state = rows.groupBy(*key).agg(F.bool_and("_done").alias("_done"))
    open_items = state.filter(~F.col("_done")).drop("_done")
    finished = state.filter("_done").select(*[F.col(k).alias(f"_need_{k}") for k in key])
    wanted = rows.filter(~F.col("_done")).select(*key, F.explode("_needs").alias("_need"))
    wanted = wanted.select(*key, *[F.col("_need")[k].alias(f"_need_{k}") for k in key])
    blocked = wanted.join(finished, list(finished.columns), "left_anti").select(*key)
    return open_items.join(blocked, list(key), "left_anti")


def rolled_up(df: DataFrame, by: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """``measures`` for every prefix of the columns ``by``, from all of them to none; depth says how many count.

    Grouping sets in one exchange, with sums in the map tasks first. A null in a
    column below depth is a value of its own; one at or past it stands for all values.
    An empty table has no totals.
    """
    depth = (F.lit(len(by)) - F.bit_count(F.grouping_id())).cast("int").alias("depth")
    return df.rollup(*by).agg(depth, *measures)
