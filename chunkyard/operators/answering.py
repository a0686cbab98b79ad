"""Answers over retrieved context: context and prompt, bounded chat history, generation, judging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.operators import models

PROMPT = "Use nothing but this context.\n%s\n\nAnswer this question from it: %s\nIf it does not hold the answer, say 'Could not find any relevant information'."


def contexts(ranked: DataFrame, limit: int | None = None) -> DataFrame:
    """(query_id, contexts, context): the texts in rank order, and joined."""
    own = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x.text)
    return own.groupBy("query_id").agg(ordered.alias("contexts")).withColumn("context", F.array_join("contexts", config.CONTEXT_SEPARATOR))


def history_window(messages: DataFrame, size: int = config.HISTORY_MESSAGES) -> DataFrame:
    """``messages`` (conv_id, turn, role, text) with ``history``: up to ``size`` messages before each, as (role, text)."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-size, -1)
    return messages.withColumn("history", F.collect_list(F.struct("role", "text")).over(before))


def rewrite_queries(questions: DataFrame, rewriter: Callable[[Column, Column], Column]) -> DataFrame:
    """``questions`` (query_id, text, history) with ``search``: rewritten from the history, unchanged without one."""
    return questions.withColumn("search", F.when(F.size("history") > 0, rewriter(F.col("text"), F.col("history"))).otherwise(F.col("text")))


def converse(
    questions: DataFrame,
    search: Callable[[DataFrame], DataFrame],
    rewriter: Callable[[Column, Column], Column] | None = models.recent_question_rewriter,
    generator: models.Generator = models.echo_generator,
    size: int = config.HISTORY_MESSAGES,
) -> DataFrame:
    """(query_id, contexts, sources, answer, history): one turn of every conversation in ``questions`` (query_id, text, history).

    ``search`` ranks chunks for (query_id, text), which holds rewritten questions (the originals for no ``rewriter``); answers
    come from the original questions. ``history`` gains question and answer, with or without context, and keeps its last ``size`` messages.
    """
    asked = questions.withColumn("search", F.col("text")) if rewriter is None else rewrite_queries(questions, rewriter)
    said = answer(questions, search(asked.select("query_id", F.col("search").alias("text"))), generator)
    turn = F.array(*[F.struct(F.lit(role).alias("role"), F.col(c).alias("text")) for role, c in (("user", "text"), ("assistant", "answer"))])
    grown = F.concat(F.col("history"), turn)
    kept = F.slice(grown, F.greatest(F.size(grown) - size + 1, F.lit(1)), F.lit(size))
    return said.join(questions.select("query_id", "text", "history"), "query_id").select("query_id", "contexts", "sources", "answer", kept.alias("history"))


def answer(questions: DataFrame, ranked: DataFrame, generator: models.Generator = models.echo_generator) -> DataFrame:
    """(query_id, contexts, sources, answer): generated from the original question; a fixed message without context."""
    held = contexts(ranked)
    named = ranked.where("source IS NOT NULL AND source <> ''").groupBy("query_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    rows = questions.select("query_id", "text").join(held, "query_id", "left").join(named, "query_id", "left")
    empty = F.array().cast("array<string>")
    said = F.when(F.col("context").isNull(), F.lit(config.NO_CONTEXT)).otherwise(generator(F.format_string(PROMPT, F.coalesce("context", F.lit("")), F.col("text"))))
    return rows.select("query_id", F.coalesce("contexts", empty).alias("contexts"), F.coalesce("sources", empty).alias("sources"), said.alias("answer"))


def answer_rows(golden: DataFrame, ranked: DataFrame, generator: models.Generator = models.echo_generator) -> DataFrame:
    """Golden rows with their contexts and answers, as stored for judging."""
    said = answer(golden.select(F.col("id").alias("query_id"), F.col("question").alias("text")), ranked, generator)
    return golden.join(said.withColumnRenamed("query_id", "id"), "id").select("id", "type", "question", F.col("expected_answer").alias("reference"), "contexts", "answer")


def judge(answers: DataFrame, scorers: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """Scores of in_corpus answers that had context; by default word overlap of answer, question and reference with their counterparts."""
    rows = answers.where("type = 'in_corpus' AND size(contexts) > 0")
    joined = F.array_join("contexts", " ")
    default = {
        "faithfulness": models.shared_words_scorer(F.col("answer"), joined),
        "relevancy": models.shared_words_scorer(F.col("question"), F.col("answer")),
        "context_recall": models.shared_words_scorer(F.col("reference"), joined),
    }
    found = {n: f(rows) for n, f in scorers.items()} if scorers else default
    return rows.select("id", F.col("question").alias("user_input"), F.col("contexts").alias("retrieved_contexts"), F.col("answer").alias("response"), "reference", *[c.alias(n) for n, c in found.items()])
