"""Where models plug in, with deterministic stand-ins that need no network.

An embedder maps a text column to vectors, a pair scorer two text columns to a number, a generator a prompt column to
text. Real models go behind the same signatures, loaded once a worker by an iterator pandas UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import text

Embedder = Callable[[Column], Column]
PairScorer = Callable[[Column, Column], Column]
Generator = Callable[[Column], Column]


def hashed_embedder(dims: int = 64) -> Embedder:
    """Counts of tokens by hash: texts that share words are near each other."""

    def embed(column: Column) -> Column:
        slots = F.transform(text.tokenize(column), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)))
        return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))

    return embed


def shared_words_scorer(query: Column, chunk: Column) -> Column:
    """The share of the query's distinct tokens that the chunk holds."""
    asked = F.array_distinct(text.tokenize(query))
    return F.size(F.array_intersect(asked, text.tokenize(chunk))) / F.greatest(F.size(asked), F.lit(1))


def echo_generator(prompt: Column) -> Column:
    """The start of the context as answer, or the fixed message where there is none."""
    body = F.trim(F.regexp_extract(prompt, r"(?s)context\.\n(.*?)\n\nAnswer", 1))
    return F.when(body == "", F.lit(config.NO_CONTEXT)).otherwise(F.substring(body, 1, 200))


def recent_question_rewriter(question: Column, history: Column) -> Column:
    """The question after the last one that the user asked before it."""
    asked = F.filter(history, lambda m: m.role == "user")
    return F.concat_ws(" ", F.try_element_at(asked, F.lit(-1)).text, question)


def model_udf(load: Callable[[], Callable[[pd.Series], pd.Series]], kind: str) -> Callable[[Column], Column]:
    """A column function for a model that ``load`` opens once a worker."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            yield model(batch)

    return run
