"""The driver's tables in the roles that retrieval needs: documents as pages, benchmark passages as golden quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import text
from chunkyard.operators import lexical, validation
from chunkyard.scratch import written
from chunkyard.sources.tables import read_table


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet", spread)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages of their source."""
    return table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), "text")


def chunks(spark: SparkSession, sf_dir: str, spread: bool = True) -> DataFrame:
    """Documents as chunks; not ``spread`` for plans that meet a few rows by key and compute nothing from the others."""
    return table(spark, sf_dir, "documents", spread).select(F.col("doc_id").alias("chunk_id"), "source", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries: whole passages."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as golden rows: in_corpus if any document holds the passage, from the first source that does. Written once."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit(0).alias("position"), F.col("text").alias("quote"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("long").alias("page"))
    quotes = items.withColumn("needle", text.normalize(F.col("quote")))
    found = validation.holding(pages(spark, sf_dir), quotes, None).groupBy("id").agg(F.min("source").alias("source"))
    rows = items.select("id", "quote").join(found, "id", "left")
    inside = F.col("source").isNotNull()
    tier = F.element_at(F.array(*map(F.lit, validation.DIFFICULTIES)), (F.col("id") % 3 + 1).cast("int"))
    quoted = F.when(inside, F.array("quote")).otherwise(F.array().cast("array<string>"))
    made = rows.select("id", F.col("quote").alias("question"), F.lit("").alias("expected_answer"), F.coalesce("source", F.lit("")).alias("source"), F.lit(None).cast("long").alias("page"), quoted.alias("gold_quotes"), F.when(inside, "in_corpus").otherwise("out_of_corpus").alias("type"), tier.alias("difficulty"))
    return written(made, "golden")


def ranked(spark: SparkSession, sf_dir: str, k: int = config.CANDIDATES) -> DataFrame:
    """The k best documents for each question by BM25, with source and text. Written once."""
    best = written(lexical.top_k(lexical.build(chunks(spark, sf_dir)), questions(spark, sf_dir), k), "best")  # its size is known then: texts don't shuffle to meet a few rows
    return written(best.join(chunks(spark, sf_dir, spread=False), "chunk_id"), "ranked")
