"""Fusion and re-ranking of ranked lists (query_id, rank, chunk_id, score)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.scratch import written


def rrf(rankings: Sequence[DataFrame], weights: Sequence[float] | None = None, rrf_k: int = config.RRF_K, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (rrf_k + rank) over the lists that hold a chunk.

    Ties go to what an earlier list holds, then to the better rank there. With fewer weights than lists, the lists without one
    are left out.
    """
    weights = [1.0] * len(rankings) if weights is None else weights
    parts = [r.select("query_id", "chunk_id", (F.lit(float(w)) / (rrf_k + F.col("rank"))).alias("part"), F.struct(F.lit(i).alias("list"), F.col("rank")).alias("seen")) for i, (r, w) in enumerate(zip(rankings, weights, strict=False))]
    fused = reduce(DataFrame.unionByName, parts).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score"), F.min("seen").alias("seen"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seen"))
    out = fused.withColumn("rank", rank)
    return (out if k is None else out.where(F.col("rank") <= k)).select("query_id", "rank", "chunk_id", "score")


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, scorer: Callable[[Column, Column], Column], top_n: int) -> DataFrame:
    """``candidates`` ordered by ``scorer(query text, chunk text)`` instead of their scores; ties keep their order."""
    candidates = written(candidates, "candidates")  # its size is known then: texts don't shuffle to meet a few rows
    pairs = candidates.join(chunks.select("chunk_id", F.col("text").alias("__c")), "chunk_id").join(queries.select("query_id", F.col("text").alias("__q")), "query_id")
    scored = pairs.select("query_id", "chunk_id", F.col("rank").alias("before"), F.round(scorer(F.col("__q"), F.col("__c")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top_n).select("query_id", "rank", "chunk_id", "score")
