"""Standardised and encoded features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tarn.functions.expressions import level
from tarn.functions.tables import together
from tarn.operators.profile import default_selection, drop_missing, missing_reason

ONE_HOT_LEVELS = 20  # fixed value: more levels are encoded by frequency


@dataclass
class Prepared:
    """Rows without missing basis values, with ``features`` array<double>, and how they came about."""

    rows: DataFrame
    names: list[str]
    used: list[str]
    dropped: int
    notes: list[str] = field(default_factory=list)


def is_numeric(df: DataFrame, column: str) -> bool:
    """Numbers and booleans count as numeric in features and metrics."""
    return isinstance(df.schema[column].dataType, (NumericType, BooleanType))


def number(column: str) -> Column:
    return F.col(column).cast("double")


def resolve_selection(df: DataFrame, profile: DataFrame, selected: Sequence[str] | None = None) -> list[str]:
    """The basis columns: given ones, or the defaults."""
    chosen = default_selection(profile) if selected is None else list(selected)
    if unknown := [c for c in chosen if c not in df.columns]:
        raise ValueError(f"columns not in the data: {', '.join(unknown)}")
    if not chosen:
        raise ValueError("no basis column is selected")
    return chosen


def override_selection(profile: DataFrame, columns: Sequence[str] | None, exclude: Sequence[str], max_missing: float | None) -> list[str]:
    """Command-line choice: an explicit list, else defaults without excluded and too incomplete ones."""
    if columns:
        return list(columns)
    kept = profile.filter("selected").orderBy("position").collect()
    return [r["name"] for r in kept if r["name"] not in exclude and (max_missing is None or r["missing_ratio"] <= max_missing)]


def zscores(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, Column], list[str]]:
    """(x - mean) / population deviation per column; constant columns are skipped with a note."""
    stats = df.agg(*[f(number(c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    out, notes = {}, []
    for i, c in enumerate(columns):
        mean, deviation = stats[f"m{i}"], stats[f"s{i}"]
        if not deviation or deviation != deviation:
            notes.append(f"{c} does not vary and is skipped")
        else:
            out[c] = (number(c) - F.lit(mean)) / F.lit(deviation)
    return out, notes


def level_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first, ties by value."""
    return df.groupBy(level(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def one_hot(df: DataFrame, column: str) -> dict[str, Column]:
    """A 0/1 column per level, most frequent first; for at most ONE_HOT_LEVELS levels."""
    return {f"{column}={r.value}": (level(column) == r.value).cast("double") for r in level_counts(df, column).limit(ONE_HOT_LEVELS).collect()}


def frequency(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``column#freq``: the share of the row's level."""
    total = df.count()
    shares = df.groupBy(level(column).alias("_level")).agg((F.count("*") / F.lit(total)).alias(f"{column}#freq"))
    return df.withColumn("_level", level(column)).join(shares, "_level").drop("_level")


def feature_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, list[str], list[str]]:
    """``df`` with ``features``, the feature names, and notes; no usable column is an error."""
    numeric = [c for c in columns if is_numeric(df, c)]
    others = [c for c in columns if c not in numeric]
    (scaled, notes), distinct = together([
        lambda: zscores(df, numeric) if numeric else ({}, []),
        lambda: df.agg(*[F.count_distinct(level(c)).alias(f"d{i}") for i, c in enumerate(others)]).first() if others else None,
    ])
    few = [c for i, c in enumerate(others) if distinct[f"d{i}"] <= ONE_HOT_LEVELS]
    coded = dict(zip(few, together([partial(one_hot, df, c) for c in few]), strict=True))
    out, blocks = df, {}
    for c in columns:
        if c in scaled:
            blocks[c] = scaled[c]
        elif c in others:
            if c in coded:
                blocks |= coded[c]
            else:
                out = frequency(out, c)
                blocks[f"{c}#freq"] = F.col(f"`{c}#freq`")
    if not blocks:
        raise ValueError("no usable feature column")
    vector = F.array(*[F.coalesce(F.nanvl(b, F.lit(0.0)), F.lit(0.0)) for b in blocks.values()])
    return out.withColumn("features", vector).select(*df.columns, "features"), list(blocks), notes


def prepare(df: DataFrame, profile: DataFrame, selected: Sequence[str] | None = None) -> Prepared:
    """Resolve the basis, drop incomplete rows, build features."""
    used = resolve_selection(df, profile, selected)
    complete, dropped = drop_missing(df, used)
    if complete.isEmpty():
        raise ValueError(f"no rows are left without missing values: {missing_reason(df.select(*used))}")
    rows, names, notes = feature_matrix(complete, used)
    return Prepared(rows, names, used, dropped, notes)
