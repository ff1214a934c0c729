"""Written intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

# Used only where the session names no folder: one machine, as in tests.
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a local folder only where that is unset and there is one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The result has no lineage above the files, so a lost executor costs one
    re-read and not a recomputation. Files stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tarn-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
