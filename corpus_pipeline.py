"""A training corpus from ``documents``: language ID, exact and near deduplication, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. The
stages are meant to be written as Parquet and read again, one after the other, as :func:`run` does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.llm.common import table, written
from chunkyard.llm.exact_dedup import exact_dedup
from chunkyard.llm.language_id import identify_languages
from chunkyard.llm.packing import pack_documents
from chunkyard.llm.registry import mixed_documents
from chunkyard.llm.simhash import near_dedup


#: What the operators read; any other column passes through them under a name of its own.
READ = ("doc_id", "text", "lang", "source")


def _kept(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that an operator keeps of ``docs``, with the columns of ``docs`` unchanged, however they are named."""
    inner = [c if c in READ else f"__c{i}" for i, c in enumerate(docs.columns)]
    kept = operator(docs.select([F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, inner, strict=True)]))
    return kept.select([F.col(n).alias(c) for c, n in zip(docs.columns, inner, strict=True)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; texts without letters go."""
    return _kept(docs, lambda d: identify_languages(d).where("accepted"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return _kept(docs, exact_dedup)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share four fifths of their five-word shingles, as SimHash fingerprints tell."""
    return _kept(docs, near_dedup)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the target weights take them: as many tokens as came in, short sources up to four times."""
    return _kept(docs, mixed_documents)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in full sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("source_mixture", source_mixture),
    ("packing", packed_sequences),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
