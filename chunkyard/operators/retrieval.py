"""Retrieval for whole sets of queries in one plan: dense, lexical, fused or re-ranked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.operators import dense, fusion, lexical, models
from chunkyard.scratch import written


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 3,
    mode: str = "dense",
    apply_threshold: bool = True,
    scorer: models.PairScorer = models.shared_words_scorer,
    index: lexical.LexicalIndex | None = None,
) -> DataFrame:
    """(query_id, rank, chunk_id, source, text, score) of the best chunks for each query; ValueError for other modes.

    ``chunks`` has chunk_id, source, text and, for all modes but bm25, vector; ``queries`` query_id, text and vector.
    Fused lists start from ``max(k, 20)`` candidates; re-ranking permutes the 20 best fused ones whatever k is. A mode's
    threshold (inclusive) is applied after the cut at k.
    """
    if mode not in config.MODES:
        raise ValueError(f"Unknown mode: {mode}")

    def by_words(n: int) -> DataFrame:
        return lexical.top_k(index or lexical.build(chunks), queries, n)

    def fused(n: int) -> DataFrame:
        return fusion.rrf([dense.top_k(chunks, queries, max(n, config.CANDIDATES)), by_words(max(n, config.CANDIDATES))], k=n)

    if mode == "dense":
        ranked = dense.top_k(chunks, queries, k)
    elif mode == "bm25":
        ranked = by_words(k)
    elif mode == "hybrid":
        ranked = fused(k)
    else:
        ranked = fusion.rerank(fused(config.CANDIDATES), queries, chunks, scorer, k)
    threshold = config.THRESHOLDS[mode]
    if apply_threshold and threshold is not None:
        ranked = ranked.where(F.col("score") >= threshold)
    ranked = written(ranked, "best")  # its size is known then: texts don't shuffle to meet a few rows
    return ranked.join(chunks.select("chunk_id", "source", "text"), "chunk_id").select("query_id", "rank", "chunk_id", "source", "text", "score")


def distinct_sources(ranked: DataFrame) -> DataFrame:
    """(query_id, sources): the distinct non-empty sources of each query's results, sorted."""
    named = ranked.where("source IS NOT NULL AND source <> ''")
    return named.groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
