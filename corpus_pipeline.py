"""From raw documents to packed sequences, a stage at a time.

``STAGES`` lists (name, function); each function takes (spark, docs, folder) and returns a
DataFrame, which is written as Parquet and read back as the next one's documents. All but
the last return the columns of ``documents``; ``n_chars``, where there is one, follows the text. The operators
define what becomes of nulls, empty texts, repeated rows and empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicpulse.llm import dedup_minhash, dedup_substring, packing, pii, toxicity
from topicpulse.session import saved


def _measured(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of each class of near-duplicates."""
    return dedup_minhash.without_near_duplicates(docs)


def drop_copied_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the passages that start in a document with a smaller id."""
    return _measured(dedup_substring.without_copies(docs))


def sanitise(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without personal data and the terms that reveal it."""
    return _measured(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents, with their token ids, in sequences that follow the sources' shares."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_copied_passages),
    ("pii", sanitise),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
