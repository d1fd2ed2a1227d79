"""A corpus from raw documents to token ids, in five stages.

Toxic documents go, one document of each group of near copies stays, documents that hold benchmark items go,
personal data is masked, and the rest is encoded. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.llm import bpe, decontam, pii, queries, simhash, toxicity
from storelens.llm.common import keep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.3; it learns from the labels outside the held-out quarter."""
    labels = table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~queries.held_out(F.col("doc_id"))))
    return toxicity.select(docs, model, below=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at 0.8 or more on five-word shingles: the one of smallest doc_id."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window at 0.8 or more to a benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked, and n_chars of the new text."""
    out = pii.sanitise(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    how = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.digests(bpe.decode(bpe.encode(docs, *how), *how), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", mask_personal),
    ("byte_bpe", encode),
]
#: Training, near copies and merges by rank are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = keep(docs, name)
    return docs
