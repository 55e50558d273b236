"""The corpus pipeline: language ID, quality, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and gives the rows it keeps, with the columns of documents; the
last gives packed pieces. Empty tables give empty results, and repeated rows and rows with null ids are taken
one by one, but for near duplicates, of which those with a null id all stay. Models are fitted on the rows a stage gets. A stage's rows are written to the
folder in spark.checkpoint.dir and read again as the next one's docs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import jaccard_join, language_mixture, packing, passage_quality, secrets
from strandline.llm.common import Scratch, bounded_batches, table
from strandline.llm.registry import WORD_MODEL

MEMO_BYTES = 16 << 20  #: That a worker remembers while it packs; the stages before it have left the executors little room.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned languages explain, one or several; text without letters, or like none of them, goes."""
    bounded_batches(spark)
    return language_mixture.identified(spark, docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier takes for good ones; all, where labels give it nothing to learn from."""
    bounded_batches(spark)
    return passage_quality.good_documents(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by five-word shingles at 0.8 or more."""
    bounded_batches(spark)
    return jaccard_join.keep_first(spark, docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their text replaced."""
    bounded_batches(spark)
    return secrets.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    bounded_batches(spark)
    return packing.pack_digests(docs, WORD_MODEL, end=2, memo=MEMO_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack),
]

#: Trained models and tokenizers decide what is kept, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES:
        last, docs = docs, scratch.write(stage(spark, docs, sf_dir))
        scratch.drop(last)  # its only reader has been written
    return docs
