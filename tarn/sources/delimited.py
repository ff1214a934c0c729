"""Delimited text: finding files, sniffing encoding and delimiter, reading, merging."""

from __future__ import annotations

import csv
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Encodings in the order tried, delimiters, and tokens that stand for null.
ENCODINGS = ("utf-8-sig", "utf-8", "cp949", "euc-kr", "latin-1")
DELIMITERS = ",\t;|"
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
SOURCE = "_source_file"
HEAD_LINES, HEAD_CHARS = 200, 8192
# What reads as a number looks so; of what looks so, the cast decides. A failed cast costs an exception, so none is tried on other texts.
FORMS = {
    "bigint": r"^[\x00-\x20\x7f]*+[+-]?+0*+[0-9]{0,19}+[\x00-\x20\x7f]*+$",
    "double": r"(?i)^[\x00-\x20\x7f]*+[+-]?+(?:nan|inf|infinity|0x[0-9a-f.]*+p[+-]?+[0-9]++|[0-9]*+(?:\.[0-9]*+)?+(?:e[+-]?+[0-9]++)?+)[fd]?+[\x00-\x20\x7f]*+$",
}
JAVA_NAMES = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp949": "x-windows-949", "euc-kr": "EUC-KR", "latin-1": "ISO-8859-1"}


PATTERN = "{*.[cC][sS][vV],*.[tT][sS][vV],*.[tT][xX][tT]}"
SNIFFED = "path string, encoding string, separator string, header array<string>, tabular boolean, problem string"


@dataclass(frozen=True)
class SourceFile:
    path: str
    name: str  # relative to the folder that was scanned
    size: int = 0


@dataclass(frozen=True)
class Format:
    """How to read one file; ``path`` is as Spark's file metadata spell it, ``problem`` says why it cannot be read."""

    path: str
    encoding: str | None
    separator: str | None
    header: tuple[str, ...]
    tabular: bool
    problem: str | None
    many_lines: bool


def _plain(path: str) -> str:
    """One spelling of a path: decoded, with one slash after the scheme of local files."""
    return re.sub("^file:/*", "/", unquote(path)).rstrip("/")


def find_files(spark: SparkSession, folder: str, recursive: bool = True) -> list[SourceFile]:
    """Delimited files of a folder on any file system that Spark reads, by relative name.

    Files whose name begins with a dot are skipped; .txt and .tsv must hold a
    delimiter in their first line. A path that is no folder is an error.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", PATTERN).option("recursiveFileLookup", recursive)
    try:
        listed = reader.load(folder).select("path", "length").collect()  # one short row a file; contents are not read
    except AnalysisException:
        raise NotADirectoryError(folder) from None
    root = _plain(folder)
    found = []
    for r in listed:
        name = _plain(r.path)
        name = name[name.index(root) + len(root) :].lstrip("/")
        if not name:
            raise NotADirectoryError(folder)
        if not name.rpartition("/")[2].startswith("."):
            found.append(SourceFile(r.path, name, r.length))
    unsure = [f.path for f in found if not f.name.lower().endswith(".csv")]
    tables = {p for p, kind in sniff(spark, unsure).items() if kind.tabular} if unsure else set()
    return sorted((f for f in found if f.path not in unsure or f.path in tables), key=lambda f: f.name)


def _sniff_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(path, lines) in, SNIFFED out."""
    for frame in frames:
        rows = []
        for path, lines in zip(frame["path"], frame["lines"], strict=True):
            lines = list(lines)
            try:
                encoding = encoding_of(b"\n".join(lines))
                first = lines[0].decode(encoding).lstrip("\ufeff") if lines else ""
                tabular = any(c in DELIMITERS for c in first)
                separator = delimiter_of(b"\n".join(lines).decode(encoding))
                rows.append((path, encoding, separator, next(csv.reader([first], delimiter=separator), []), tabular, None))
            except ValueError as e:
                rows.append((path, None, None, [], False, str(e)))
        yield pd.DataFrame(rows, columns=["path", "encoding", "separator", "header", "tabular", "problem"])


def sniff(spark: SparkSession, paths: Sequence[str]) -> dict[str, Format]:
    """The format of every file, from its first HEAD_LINES lines, in one job over all files.

    A line with an odd number of quotes tells of a value that spans lines.
    """
    text = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin"), "value")
    quotes = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2 == 1
    spanning = text.groupBy("path").agg(F.bool_or(quotes).alias("many_lines"))
    order = Window.partitionBy("path").orderBy("at")
    head = text.filter("begin = 0").select("path", F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("line"))
    head = head.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= HEAD_LINES)
    lines = head.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    made = lines.mapInPandas(_sniff_task, SNIFFED).join(spanning, "path").collect()  # one short row a file
    known = {_plain(r.path): Format(r.path, r.encoding, r.separator, tuple(r.header), r.tabular, r.problem, r.many_lines) for r in made}
    empty = Format("", None, None, (), False, "the file is empty", False)
    return {p: known.get(_plain(p), empty) for p in paths}


def encoding_of(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            raw.decode(name)
        except UnicodeDecodeError:
            continue
        return name
    raise ValueError("no encoding fits")


def delimiter_of(text: str) -> str:
    """The dialect's delimiter, else the commonest in the first line, else a comma; blank text is an error."""
    if not text.strip():
        raise ValueError("the file is empty")
    try:
        return csv.Sniffer().sniff(text[:HEAD_CHARS], DELIMITERS).delimiter
    except csv.Error:
        counts = Counter(c for c in text.splitlines()[0] if c in DELIMITERS)
        return counts.most_common(1)[0][0] if counts else ","


def detect_encoding(spark: SparkSession, path: str) -> str:
    """The first encoding that decodes the first 200 lines."""
    found = sniff(spark, [path])[path]
    return found.encoding or ENCODINGS[0]


def is_tabular(spark: SparkSession, path: str) -> bool:
    """Whether the first line holds a delimiter."""
    return sniff(spark, [path])[path].tabular


def _reader(spark: SparkSession, encoding: str, separator: str, many_lines: bool):
    if encoding in ("cp949", "euc-kr"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark refuses these charsets else
    # Files with values that span lines cannot be cut into splits; all others are.
    return spark.read.option("header", True).option("encoding", JAVA_NAMES[encoding]).option("sep", separator).option("inferSchema", False).option("multiLine", many_lines).option("escape", '"')


def _typed(df: DataFrame, untouched: Sequence[str] = ()) -> DataFrame:
    """Null tokens become null; whole columns become boolean, long or double if every value reads so."""
    names = [c for c in df.columns if c not in untouched]
    cleaned = df.select(*[F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in names], *untouched)

    def reads(c: Column, kind: str) -> Column:
        return F.count(F.when(c.rlike(FORMS[kind]), F.trim(c).try_cast(kind))) == F.count(c)

    tests = [t.alias(f"{k}{i}") for i, c in enumerate(names) for k, t in (("n", F.count(F.col(f"`{c}`"))), ("l", reads(F.col(f"`{c}`"), "bigint")), ("d", reads(F.col(f"`{c}`"), "double")), ("b", F.count_if(F.col(f"`{c}`").isin("True", "False", "true", "false", "TRUE", "FALSE")) == F.count(F.col(f"`{c}`"))))]
    row = cleaned.agg(*tests).first()
    out = []
    for i, c in enumerate(names):
        kind = "string" if not row[f"n{i}"] else "boolean" if row[f"b{i}"] else "bigint" if row[f"l{i}"] else "double" if row[f"d{i}"] else "string"
        col = F.col(f"`{c}`")
        out.append((F.trim(col).cast(kind) if kind != "string" else col).alias(c))
    return cleaned.select(*out, *untouched)


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, rows: int | None = None) -> tuple[DataFrame, str]:
    """The table of one file, typed, and its encoding. Empty and column-less files are errors."""
    found = sniff(spark, [path])[path]
    if found.problem:
        raise ValueError(f"{found.problem}: {path}")
    encoding = encoding or found.encoding
    df = _reader(spark, encoding, found.separator, found.many_lines).csv(path)
    if not df.columns:
        raise ValueError(f"no columns: {path}")
    df = df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})
    return _typed(df.limit(rows) if rows else df), encoding


def headers(spark: SparkSession, files: Sequence[SourceFile]) -> dict[str, Format]:
    """The format, with column names, of every file by its name."""
    found = sniff(spark, [f.path for f in files])
    return {f.name: found[f.path] for f in files}


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names alone."""
    found = sniff(spark, [path])[path]
    if found.problem:
        raise ValueError(f"{found.problem}: {path}")
    return list(found.header)


def merge_group(spark: SparkSession, files: Sequence[SourceFile]) -> DataFrame:
    """All rows of files with one header, with the file's name in _source_file.

    Files of one encoding and delimiter are read together, and types are inferred
    over all of them, so the plan grows with the formats and not with the files.
    """
    if not files:
        raise ValueError("nothing to merge")
    found = sniff(spark, [f.path for f in files])
    if unreadable := [f"{found[f.path].problem}: {f.name}" for f in files if found[f.path].problem]:
        raise ValueError("; ".join(unreadable))
    names = spark.createDataFrame([(found[f.path].path, f.name) for f in files], f"_path string, {SOURCE} string")
    kinds: dict[tuple, list[str]] = {}
    for f in files:
        kind = found[f.path]
        kinds.setdefault((kind.encoding, kind.separator, kind.many_lines), []).append(f.path)
    tables = []
    for (encoding, separator, many_lines), paths in kinds.items():
        df = _reader(spark, encoding, separator, many_lines).csv(paths)
        columns = [c.lstrip("\ufeff") for c in df.columns]
        df = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, columns, strict=True)], F.col("_metadata.file_path").alias("_path"))
        # One short row per file, listed by the driver; a shuffle would send a whole file to one task and lose the order of its lines.
        tables.append(df.join(F.broadcast(names), "_path").select(*[f"`{c}`" for c in columns], SOURCE))
    return _typed(reduce(DataFrame.unionByName, tables), untouched=(SOURCE,))


def with_row_id(df: DataFrame) -> DataFrame:
    """``df`` with _row_id, which follows file and line order inside each partition."""
    return df.withColumn("_row_id", F.monotonically_increasing_id())


def write_delimited(df: DataFrame, path: str, encoding: str = "UTF-8", separator: str = ",") -> None:
    """A folder of CSV parts with headers."""
    if encoding in ("cp949", "euc-kr"):
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    df.write.mode("overwrite").option("header", True).option("sep", separator).option("encoding", JAVA_NAMES.get(encoding, encoding)).csv(path)


def write_reduced(df: DataFrame, path: str) -> None:
    """The reduced table: _weight first, then every column; UTF-8, and a byte order mark in the first header."""
    rest = [c for c in df.columns if c != "_weight"]
    marked = df.select(F.col("_weight").alias("﻿_weight"), *rest)
    write_delimited(marked, path)
