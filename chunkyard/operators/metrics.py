"""Retrieval metrics over a ranked table and a golden set, one aggregation for all cut-offs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import text


def is_hit(chunk: Column, quotes: Column) -> Column:
    """Whether a chunk's text holds any quote, both normalized. Sources are compared by the join."""
    folded = text.normalize(chunk)
    return F.coalesce(F.exists(quotes, lambda q: F.contains(folded, text.normalize(q))), F.lit(False))


def hits(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """(id, rank, score, chunk_id, found) for results from a question's own source that hold a quote; ``found`` lists the quotes' positions."""
    asked = golden.where("type = 'in_corpus'").select("id", F.col("source").alias("gold_source"), F.transform("gold_quotes", text.normalize).alias("quotes"))
    own = ranked.select(F.col("query_id").alias("id"), "rank", "chunk_id", "source", "score", text.normalize(F.col("text")).alias("folded"))
    joined = asked.join(own, "id").where("gold_source = source")
    places = F.filter(F.sequence(F.lit(1), F.size("quotes")), lambda i: F.contains(F.col("folded"), F.element_at("quotes", i)))
    return joined.where("size(quotes) > 0").withColumn("found", places).where("size(found) > 0").select("id", "rank", "score", "chunk_id", "found")


def per_question(ranked: DataFrame, golden: DataFrame, ks: Sequence[int] = config.EVAL_KS) -> DataFrame:
    """One row per in_corpus question: hit@k and recall@k for every k, and rr, the reciprocal rank of the first hit (0.0 without)."""
    found = hits(ranked, golden)
    quotes = found.select("id", "rank", F.explode("found").alias("quote")).groupBy("id", "quote").agg(F.min("rank").alias("rank"))
    best = [F.max(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hit@{k}") for k in ks]
    seen = [F.count_if(F.col("rank") <= k).alias(f"quotes@{k}") for k in ks]
    firsts = quotes.groupBy("id").agg(F.min("rank").alias("first"), *best, *seen)
    asked = golden.where("type = 'in_corpus'").select("id", "difficulty", F.size("gold_quotes").alias("n_quotes"))
    joined = asked.join(firsts, "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "id", "difficulty",
        *[zero(F.col(f"`hit@{k}`")).alias(f"hit@{k}") for k in ks],
        *[zero(F.try_divide(F.col(f"`quotes@{k}`"), F.col("n_quotes"))).alias(f"recall@{k}") for k in ks],
        zero(1.0 / F.col("first")).alias("rr"),
    )


def scores(questions: DataFrame, ks: Sequence[int] = config.EVAL_KS) -> DataFrame:
    """Means of :func:`per_question`'s rows by difficulty, and for all questions (difficulty null), with their number ``n``."""
    names = [f"hit@{k}" for k in ks] + [f"recall@{k}" for k in ks]
    means = [F.round(F.avg(f"`{n}`"), 6).alias(n) for n in names] + [F.round(F.avg("rr"), 6).alias("mrr")]
    return questions.rollup("difficulty").agg(F.count(F.lit(1)).alias("n"), *means)


def misses(ranked: DataFrame, golden: DataFrame, k: int = 5) -> DataFrame:
    """(id, difficulty, question, top): in_corpus questions without a hit in the first k, with the sources of the first three."""
    right = hits(ranked, golden).where(F.col("rank") <= k).select("id").distinct()
    ordered = F.array_sort(F.collect_list(F.struct("rank", text.source_prefix(F.col("source")).alias("s"))))
    top = ranked.where("rank <= 3").groupBy(F.col("query_id").alias("id")).agg(F.transform(ordered, lambda x: x.s).alias("top"))
    wrong = golden.where("type = 'in_corpus'").join(right, "id", "left_anti").join(top, "id", "left")
    return wrong.select("id", "difficulty", F.substring("question", 1, 80).alias("question"), F.coalesce("top", F.array().cast("array<string>")).alias("top"))


def score_distribution(ranked: DataFrame, golden: DataFrame) -> DataFrame:
    """(type, id, score): an in_corpus question's first correct score, an out_of_corpus question's best score, to 3 places."""
    right = hits(ranked, golden).groupBy("id").agg(F.min_by("score", "rank").alias("score")).select(F.lit("in_corpus").alias("type"), "id", F.round("score", 3).alias("score"))
    outside = golden.where("type = 'out_of_corpus'").select("id").join(ranked.where("rank = 1").select(F.col("query_id").alias("id"), "score"), "id")
    return right.unionByName(outside.select(F.lit("out_of_corpus").alias("type"), "id", F.round("score", 3).alias("score")))


def separability(distribution: DataFrame) -> DataFrame:
    """One row: lowest correct score, highest score outside, and whether a threshold fits between (null if a side is empty)."""
    low = F.min(F.when(F.col("type") == "in_corpus", F.col("score"))).alias("lowest_in")
    high = F.max(F.when(F.col("type") == "out_of_corpus", F.col("score"))).alias("highest_out")
    return distribution.agg(low, high).withColumn("separable", F.col("highest_out") < F.col("lowest_in"))


def refusal_rates(answers: DataFrame) -> DataFrame:
    """One row: the share of refusals outside the corpus and, as false_refusal_rate, inside; null where a group is empty."""
    said = answers.select("type", text.refused(F.col("answer")).cast("double").alias("refused"))
    rate = lambda kind: F.round(F.avg(F.when(F.col("type") == kind, F.col("refused"))), 6)
    return said.agg(rate("out_of_corpus").alias("refusal_rate"), rate("in_corpus").alias("false_refusal_rate"))


def checked_refusal_rates(answers: DataFrame) -> dict[str, float]:
    """:func:`refusal_rates` as a dictionary; ValueError if either group is empty."""
    row = refusal_rates(answers).first().asDict()
    if None in row.values():
        raise ValueError("both in_corpus and out_of_corpus answers are needed")
    return row


def _cells(metrics: Sequence[str]) -> list[Column]:
    return [F.when(F.col(f"`{m}`").isNotNull(), F.format_string("%.3f", F.col(f"`{m}`"))).otherwise("not built").alias(m) for m in metrics]


def by_collection(results: DataFrame, mode: str = "dense", metrics: Sequence[str] = ("hit@1", "hit@3", "hit@5", "mrr")) -> DataFrame:
    """One row a collection that has (collection, mode, metric, value) results in a mode, sorted by name: the metrics to 3 decimals."""
    wide = results.where(F.col("mode") == mode).groupBy("collection").pivot("metric", list(metrics)).agg(F.first("value"))
    return wide.select("collection", *_cells(metrics)).orderBy("collection")


def comparison(results: DataFrame, modes: Sequence[str] = config.MODES, metrics: Sequence[str] = ("hit@1", "hit@3", "hit@5", "hit@20", "mrr")) -> DataFrame:
    """One row a mode of (mode, metric, value) results: the metrics to 3 decimals, "not built" where there is none."""
    wide = results.groupBy("mode").pivot("metric", list(metrics)).agg(F.first("value"))
    listed = results.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    return listed.join(wide, "mode", "left").select("mode", *_cells(metrics))
