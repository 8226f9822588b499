"""From raw documents to token ids: quality rules, deduplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame, which `run` writes as Parquet
to the shared folder of spark.checkpoint.dir and reads again for the next one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm import (
    exact_dedup,
    minhash_dedup,
    mixing,
    quality_rules,
    sentencepiece_codec,
)
from labelloom.session import materialize, settle

# Near copies: five words a shingle and a similarity of 0.8.
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the adaptive fences let through."""
    return quality_rules.filter_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return minhash_dedup.drop_near_copies(
        docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it, in training order."""
    plan = settle(spark, "mix-plan", lambda: mixing.plan_mix(docs))
    return mixing.arrange(docs, plan)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the source bytes of every piece, in training order."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    encoded = sentencepiece_codec.encode_documents(docs, model)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "starts", "ends"
    )


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("mixing", mix),
    ("encoding", encode),
]

# A mix by hash order with token ids is not SQL; the tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
