"""The training-text pipeline: five stages over documents, each written and read again before the next.

Stages take (spark, docs, sf_dir). All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daqframe.llm import neardup, packing, quality_classifier, secrets, substring
from daqframe.llm.session import table, written

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _sized(docs: DataFrame) -> DataFrame:
    """docs with n_chars of the texts as they are now."""
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score_rows(docs, model, keep_from=quality_classifier.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that shares four fifths of its five-word shingles."""
    return neardup.representatives(docs, neardup.Settings(shingle=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 50 words and more that a document of a smaller doc_id has."""
    return _sized(substring.without_repeats(docs))


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return _sized(secrets.redacted(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences."""
    return packing.packed(docs, VOCABULARY)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("secret scans", secret_spans),
    ("best-fit packing", sequences),
]

# the classifier and the tokenizer have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
