"""Keys, draws and divergence terms as Spark columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATOR = chr(31)  # fixed value: joins the parts of a composite key
MISSING = "nan"  # fixed value: the level that a null counts as


def level(column: str | Column) -> Column:
    """A categorical value as text; a null is a level of its own."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(MISSING))


def composite_key(df: DataFrame, columns: Sequence[str]) -> Column:
    """One text key over several columns; unknown names or none at all are errors."""
    if unknown := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns not in the data: {', '.join(unknown)}")
    if not columns:
        raise ValueError("at least one column is needed")
    return F.concat_ws(SEPARATOR, *[level(c) for c in columns])


def digest(key: Column, seed: int) -> Column:
    """A reproducible pseudo-random text per key: md5 of "seed:key"."""
    return F.md5(F.concat(F.lit(f"{seed}:"), level(key)).cast("binary"))


def uniform(key: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) per key, from the first 32 bits of its digest."""
    return (F.conv(F.substring(digest(key, seed), 1, 8), 16, 10).cast("long") + 1) / F.lit(4294967297.0)


def js_term(p: Column, q: Column) -> Column:
    """One level's share of the Jensen-Shannon divergence in bits."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    return 0.5 * half(p, q) + 0.5 * half(q, p)


def js_distance(total: Column) -> Column:
    """The distance (square root) for summed terms, held in [0, 1]."""
    return F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), total)))
