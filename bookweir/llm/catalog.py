"""One query per corpus operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from bookweir.llm import bpe, dedup, langid, lm, main_text, merkle, mixing, near, negatives, pii, quality, token_counts, word_bpe
from bookweir.llm.work import ready
from bookweir.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    _QUERIES[run.__name__] = lambda spark, folder: run(ready(spark), folder)
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


@_query
def op1_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    return lm.text_scores(table(spark, folder, "documents"))


@_query
def op2_disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.span_digests(table(spark, folder, "documents"))


@_query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(table(spark, folder, "pages"))


@_query
def op4_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_duplicates(table(spark, folder, "documents"))


@_query
def op5_quality_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdicts(table(spark, folder, "documents"))


@_query
def op6_language_bayes(spark: SparkSession, folder: str) -> DataFrame:
    return langid.languages(table(spark, folder, "documents"))


@_query
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@_query
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op9_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.exact_groups(table(spark, folder, "documents"))


@_query
def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_shares(table(spark, folder, "documents"))


@_query
def op11_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return word_bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mined(table(spark, folder, "embeddings"))


@_query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"))


# Each query in DuckDB SQL, where SQL can express it.
_ORACLES = {
    "op9_exact_dedup": r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
g AS (SELECT doc_id, t, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size FROM n WINDOW w AS (PARTITION BY t))
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g""",
    "op12_hard_negatives": negatives.ORACLE_SQL,
    "op13_merkle_manifest": merkle.ORACLE_SQL,
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
