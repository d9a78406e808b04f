"""A corpus from raw documents to token ids: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from interviewflow.llm.bpe import encode_texts
from interviewflow.llm.quality import keep_quality
from interviewflow.llm.queries import vocabulary_path
from interviewflow.llm.secrets import redact_secrets
from interviewflow.llm.simhash import keep_one_of_each
from interviewflow.llm.store import stored
from interviewflow.llm.tiling import decontaminate


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays: three-word shingles, three bits."""
    return keep_one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark passage go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text decoded from them; a null text stays null."""
    encoded = encode_texts(docs, vocabulary_path(), outputs=["n_tokens", "ids", "decoded"])
    decoded = F.when(F.col("text").isNotNull(), F.col("decoded"))
    return encoded.withColumn("text", decoded).drop("decoded")


STAGES = [
    ("quality rules", quality),
    ("near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]

# SQL has no 64-bit xxHash, no tiling and no BPE; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
