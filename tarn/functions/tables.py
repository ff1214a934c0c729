"""Intermediate tables in the folder that driver and executors share, and jobs side by side."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

# Used only where the session names no folder: one machine, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"
PART_ROWS = 1_000_000  # rows of a dealt part, about


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (base or LOCAL_FALLBACK).rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table without lineage: what a lost executor costs is one more read."""
    path = f"{shared_folder(df.sparkSession)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def together(calls: Sequence[Callable[[], Any]]) -> list:
    """What the calls return; their jobs run side by side, in the caller's job group. None needs what another makes."""
    if len(calls) < 2:
        return [c() for c in calls]
    inherit = inheritable_thread_target(SparkSession.active())
    with ThreadPoolExecutor(len(calls)) as pool:
        begun = [pool.submit(inherit(c)) for c in calls]
        return [b.result() for b in begun]


def dealt(df: DataFrame, key: Sequence[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``df`` dealt by key where its files make fewer parts than there are task slots, or parts of over ``part_rows`` rows."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // part_rows))
    return df.repartition(parts, *key) if df.rdd.getNumPartitions() < parts else df
