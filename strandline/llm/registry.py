"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandline.llm import binary_search, jaccard_join, language_mixture, learned_partitions, merge_encoding, oracle, packing, passage_quality, secrets, token_counts, urls
from strandline.llm.common import table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD_MODEL = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(spark, table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_digests(table(spark, sf_dir, "documents"), WORD_MODEL, end=2)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op4_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned_partitions.search(spark, table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_mixture.learn(language_mixture.training_rows(docs))
    return language_mixture.predict(spark, docs, model)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_encoding.digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_binary_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_search.search(spark, table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=10)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return passage_quality.predict(spark, docs, passage_quality.learn(docs, table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark, table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard, op2_packing, op3_secrets, op4_learned_partitions, op5_token_counts, op6_language_id, op7_sentencepiece, op8_binary_codes, op9_quality, op10_url_filter)}
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard": oracle.JACCARD,
    "op10_url_filter": oracle.URLS,
    "op8_binary_codes": """
WITH usable AS (
  SELECT vec_id, [CASE WHEN x > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FOR x IN embedding] AS bits
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(q.bits) + list_sum(v.bits) - 2 * list_dot_product(q.bits, v.bits) AS INTEGER) AS distance
  FROM usable q JOIN usable v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.bits) = len(v.bits)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance
  FROM pairs
)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
""",
}
