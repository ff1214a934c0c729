"""Report sinks: nested results as JSON, tables as CSV."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tarn.sources.delimited import write_delimited


def write_report(spark: SparkSession, report: Mapping[str, Any], path: str) -> None:
    """One JSON document, through Spark so that any file system takes it."""
    text = json.dumps(report, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str) -> bool:
    """A table as CSV; an empty one is not written."""
    if df.isEmpty():
        return False
    write_delimited(df, path)
    return True
