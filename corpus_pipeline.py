"""The corpus pipeline: quality rules, exact and near duplicates, mixing, byte-level BPE.

Every stage takes the documents that the one before left, all of them, and the first four
return the columns of documents as they came. A document that the rules reject is gone; of
equal texts and of each group of near duplicates one stays; the mix takes documents not at
all, once or twice; the last stage gives the ids of each document taken.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bookweir.llm import bpe, dedup, mixing, near, quality
from bookweir.llm.work import ready, settle
from bookweir.sources.tables import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return quality.good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return near.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each time a document is taken: doc_id, n_tokens, ids and the digest of what they decode to."""
    ready(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encoded(docs, path, keep=["doc_id"]).select("row.doc_id", "out.n_tokens", "out.ids", "out.decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("byte_bpe", byte_bpe),
]

# The prefix join, the splitting tree and the merges have no SQL; tests compare with plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table; each result is written before the next starts."""
    docs = table(ready(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
