"""The corpus pipeline: five stages, each written as Parquet and reread as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarn.llm import language, likeness, packing, raking, repeats
from tarn.llm.catalogue import tokenizer_path
from tarn.llm.scratch import write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters or far from every learned language go."""
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group; no pair of the similarity is left out."""
    return likeness.keep_one(docs, exact=True)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that stand earlier in the corpus."""
    return repeats.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics reach their target shares, 90 % of the tokens at most.

    Targets are the natural shares raised to 0.9: no document is taken twice, so
    flatter targets would leave fewer tokens.
    """
    drawn = raking.mix(docs, temperature=0.9, keep=0.9, tolerance=0.001)
    return drawn.filter("_kept").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents, placed into sequences of 4096."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

# Language models, suffix sorting and tokenising are beyond SQL; tests/llm holds
# the operators against brute-force versions, and the stages against planted cases.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Null texts and texts without letters go in the first stage; an empty table
    gives an empty result at every stage; other columns pass through all stages
    but the last. Repeated rows are one document from near_duplicates on.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
