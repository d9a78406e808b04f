"""Queries that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.llm.bpe import encode_texts
from interviewflow.llm.chat import chat_digest
from interviewflow.llm.katz import katz_scores
from interviewflow.llm.lengths import token_answers, token_counts
from interviewflow.llm.passages import passage_digest
from interviewflow.llm.pii import pii_digest
from interviewflow.llm.quality import quality_digest
from interviewflow.llm.search import search
from interviewflow.llm.secrets import secret_digest
from interviewflow.llm.simhash import simhash_groups
from interviewflow.llm.sql import oracles
from interviewflow.llm.substrings import repeat_digest
from interviewflow.llm.tiling import contained_items
from interviewflow.llm.whitening import whitening_digest

PROBE = "\\### Assistant: </turn> ok"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the driver finds a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(documents(spark, sf_dir))


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    outputs = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return encode_texts(docs, vocabulary_path(), outputs=outputs).select("doc_id", *outputs)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_digest(documents(spark, sf_dir))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(documents(spark, sf_dir))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    return chat_digest(conversations.unionByName(probe))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_answers(token_counts(documents(spark, sf_dir), vocabulary_path()))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_digest(documents(spark, sf_dir))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_katz": op3_katz,
    "op4_repeats": op4_repeats,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_pii": op8_pii,
    "op9_chat": op9_chat,
    "op10_token_counts": op10_token_counts,
    "op11_passages": op11_passages,
    "op12_search": op12_search,
    "op13_whitening": op13_whitening,
}


ORACLES: dict[str, str] = oracles(PROBE)
