"""A training corpus from `documents`: quality, exact dedup, near-dedup, mixing, tokens.

Each stage takes what its predecessor kept, whole, and returns the columns of documents; the last returns the token ids.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralign.llm import bpe, exact_dedup, mixing, near_dedup, quality
from terralign.llm.common import checkpoint_folder, delete_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose perplexity is above the limit of their language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of texts that share 0.8 of their five-word shingles."""
    return near_dedup.deduplicate(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each row as often as the mix of its source takes it."""
    return mixing.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids of each row, and the digest of what they decode to."""
    coded = bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_duplicates),
    ("near dedup", near_duplicates),
    ("source mix", source_mix),
    ("byte bpe", byte_bpe),
]

#: The trained model and the signatures can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between two stages lies as Parquet in the shared checkpoint folder.

    A stage's rows are deleted once the next one's are written; those that the last stage reads stay.
    """
    checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{i}")
            if i:
                delete_folder(spark, f"{folder}/{i - 1}")
            docs = spark.read.parquet(f"{folder}/{i}")
    return docs
