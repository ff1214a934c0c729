"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import dialogue, histogramsort, language, normbuckets, packing, passages, permutations, quality, raking, repeats, revisits, simhash, spelling

from tarn.llm.scratch import write_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = packing.TOKENIZER) -> str:
    """Where the public tokenizer's file is; its folder is a parameter of the environment, not of the repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The captures are derived from the pages' bodies: once, and without them from there on.
    found = revisits.resolve_revisits(write_table(revisits.captures(table(spark, sf_dir, "pages")), "captures"))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.withColumn("headers", F.array_join(lines, "; "))


def op2_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normbuckets.exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = raking.mix(table(spark, sf_dir, "documents"))
    return drawn.select(
        "doc_id",
        F.col("_source").alias("source"),
        F.col("_lang").alias("lang"),
        F.col("_topic").alias("topic"),
        F.col("_tokens").alias("tokens"),
        F.round("_ratio", 6).alias("ratio"),
        F.round("_probability", 6).alias("probability"),
        F.col("_kept").alias("kept"),
    )


def op5_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=100)
    return found.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutations.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", every=20, k=20)


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = histogramsort.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected", "nats")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"), slip=97)


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.remove_passages(table(spark, sf_dir, "documents"), length=13)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.digest(dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_revisits, op2_norm_buckets, op3_packing, op4_mixing, op5_suffix_repeats, op6_quality, op7_permutations, op8_histogram_sort, op9_simhash, op10_language, op11_spelling, op12_passages, op13_dialogue)}


def oracle_sql() -> dict[str, str]:
    return {"op1_revisits": revisits.REVISITS_SQL, "op4_mixing": raking.mix_sql(), "op12_passages": passages.PASSAGES_SQL}
