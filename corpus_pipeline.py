"""The corpus pipeline: language ID, near-dedup, mixing to target weights, BPE encoding and decoding.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard, langid, mixing, queries
from quillspark.llm.common import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier knows with a calibrated probability of 0.4 or more; texts without letters go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 0.8 or more over five-word shingles links, that with the smallest id."""
    return jaccard.keep_one(docs, words=5, threshold=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mix order: sources at weights of size ** 0.9, then what the larger ones have left."""
    return mixing.mixed_documents(docs)


def encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, digests of the ids and of the text decoded from them, and ``position``, the document's place in the mix."""
    rows = mixing.positioned(docs).select(F.struct("doc_id", "position").alias("doc_id"), "text")
    return queries.bpe_digest(rows).select("doc_id.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "doc_id.position")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("encode_decode", encode_decode)]

#: A trained classifier and MinHash can't be stated in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each on what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
