"""Semantic kinds of columns, default selection, missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegralType, NumericType, StringType, TimestampNTZType, TimestampType

# Fixed values of the kind rules.
SAMPLE_ROWS, DATE_SAMPLE, DATE_SHARE = 5000, 200, 0.9
ID_RATIO, ID_STEP_SHARE, ID_LEAST_ROWS = 0.98, 0.9, 3
NAMED_ID_LEVELS, STRING_ID_RATIO, LONG_TEXT, TEXT_LEVELS, MAX_MISSING = 20, 0.9, 40, 200, 0.5
ID_NAME = r"(?i)(^|_)(id|no|num|code|key|seq|번호|코드)(_|$)"
UNSELECTED_KINDS = ("datetime", "identifier", "text", "constant")
DATE_FORMATS = (
    "yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd", "M/d/yyyy", "MMM d yyyy", "MMM d, yyyy", "d MMM yyyy",
    "yyyy-M-d H:m", "yyyy-M-d H:m:s", "yyyy/M/d H:m:s", "yyyy-MM-dd'T'HH:mm:ss",
)

PROFILE = "position int, name string, kind string, dtype string, unique_ratio double, missing_ratio double, reason string, selected boolean"


def parses_as_date(column: Column) -> Column:
    """Whether a text reads as a date in one of the known forms."""
    return F.coalesce(*[F.try_to_timestamp(column, F.lit(f)) for f in DATE_FORMATS], column.try_cast("timestamp")).isNotNull()


def datetime_share(df: DataFrame, column: str) -> DataFrame:
    """One row (share): of the first 200 values, how many read as dates."""
    first = df.filter(F.col(column).isNotNull()).select(column).limit(DATE_SAMPLE)
    return first.agg(F.coalesce(F.avg(parses_as_date(F.col(column)).cast("int")), F.lit(0.0)).alias("share"))


def step_share(df: DataFrame, column: str) -> DataFrame:
    """One row (share): how many neighbours of the sorted values differ by exactly 1, without sorting them.

    That is how many distinct values have their successor among the values.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    distinct = values.distinct()
    followed = distinct.join(distinct.select((F.col("v") - 1).alias("v")), "v", "left_semi").agg(F.count("*").alias("steps"))
    return values.agg(F.count("*").alias("n")).crossJoin(followed).select(F.coalesce(F.try_divide("steps", F.col("n") - 1), F.lit(0.0)).alias("share"))  # one row each


def is_identifier(ratio: float, rows: int, missing: int, named: bool, steps: float) -> bool:
    """The rule for whole numbers; one with missing values is never an identifier."""
    return not missing and ratio > ID_RATIO and (named or (rows >= ID_LEAST_ROWS and steps >= ID_STEP_SHARE))


def classify(df: DataFrame, sample_rows: int | None = SAMPLE_ROWS) -> DataFrame:
    """The profile: one row per column, inferred from the first ``sample_rows`` rows."""
    import re

    sample = df.limit(sample_rows) if sample_rows else df
    fields = df.schema.fields
    parts = [F.count("*").alias("rows")]
    for i, f in enumerate(fields):
        parts += [F.count(f.name).alias(f"n{i}"), F.count_distinct(f.name).alias(f"d{i}")]
        if isinstance(f.dataType, StringType):
            parts.append(F.avg(F.length(f.name)).alias(f"l{i}"))
    row = sample.agg(*parts).first()
    found = []
    for i, f in enumerate(fields):
        there, distinct = row[f"n{i}"], row[f"d{i}"]
        ratio = distinct / there if there else 0.0
        missing = 1 - there / row.rows if row.rows else 0.0
        named = bool(re.search(ID_NAME, f.name))
        if distinct == 1:
            kind = "constant"
        elif isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType)):
            kind = "datetime"
        elif isinstance(f.dataType, StringType) and there and datetime_share(sample, f.name).first()[0] >= DATE_SHARE:
            kind = "datetime"
        elif isinstance(f.dataType, BooleanType):
            kind = "categorical"
        elif isinstance(f.dataType, IntegralType) and ratio > ID_RATIO:
            steps = 1.0 if named else step_share(sample, f.name).first()[0]
            kind = "identifier" if is_identifier(ratio, there, row.rows - there, named, steps) else "numeric"
        elif isinstance(f.dataType, NumericType):
            kind = "numeric"
        elif isinstance(f.dataType, StringType):
            size = row[f"l{i}"] or 0.0
            if (named and distinct >= NAMED_ID_LEVELS) or (ratio > STRING_ID_RATIO and size <= LONG_TEXT):
                kind = "identifier"
            else:
                kind = "text" if size > LONG_TEXT or distinct > TEXT_LEVELS else "categorical"
        else:
            kind = "text"
        if missing > MAX_MISSING:
            reason = f"{missing:.0%} missing"
        else:
            reason = f"{kind} columns are left out" if kind in UNSELECTED_KINDS else ""
        found.append((i, f.name, kind, f.dataType.simpleString(), round(ratio, 4), round(missing, 4), reason, not reason))
    return df.sparkSession.createDataFrame(found, PROFILE)


def default_selection(profile: DataFrame) -> list[str]:
    """Names of the selected columns, in order: a profile has one row per column."""
    return [r["name"] for r in profile.filter("selected").orderBy("position").collect()]


def missing_report(df: DataFrame) -> DataFrame:
    """(column, ratio): share of nulls per column, largest first."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(c).alias("column"), F.coalesce(F.col(f"`{c}`"), F.lit(0.0)).alias("ratio")) for i, c in enumerate(df.columns)])
    return shares.select(F.explode(pairs).alias("p")).select("p.*").orderBy(F.desc("ratio"), "at").select("column", "ratio")


def missing_reason(df: DataFrame) -> str:
    """The five columns with most nulls, as a message."""
    worst = missing_report(df).filter("ratio > 0").limit(5).collect()
    return ", ".join(f"{r['column']} ({r['ratio']:.1%} missing)" for r in worst) or "no missing values"


def drop_missing(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, int]:
    """Rows with values in all ``columns``, and how many went."""
    if not columns:
        return df, 0
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    return df.dropna(subset=list(columns)), df.agg(F.count_if(~complete)).first()[0]


def group_by_header(files: DataFrame) -> DataFrame:
    """(header, files, merge) for (file, header array): most files first."""
    grouped = files.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"), F.count("*").alias("n"))
    return grouped.select("header", "files", "n", (F.col("n") > 1).alias("merge")).orderBy(F.desc("n"), "header")
