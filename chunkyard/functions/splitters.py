"""Recursive text splitting, as plain functions and as columns."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Separators from coarse to fine. Those for Markdown are regular expressions.
PLAIN = ("\n\n", "\n", " ", "")
MARKDOWN = (r"\n#{1,6} ", "```\n", r"\n\*\*\*+\n", r"\n---+\n", r"\n___+\n", r"\n\n", r"\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Text cut before each separator, which opens the piece that follows it."""
    if not separator:
        return list(text)
    cuts = [0, *(m.start() for m in re.finditer(separator, text) if m.start()), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if a < b]


def _packed(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Neighbours joined up to ``size``; each chunk starts with the tail of the one before, up to ``overlap``."""
    out: list[str] = []
    first = total = 0
    for i, piece in enumerate(pieces):
        if total + len(piece) > size and i > first:
            out.append("".join(pieces[first:i]))
            while first < i and (total > overlap or total + len(piece) > size):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    out.append("".join(pieces[first:]))
    return [x for x in (chunk.strip() for chunk in out) if x]


def split_text(text: str, size: int, overlap: int = 0, separators: tuple[str, ...] = PLAIN, plain: bool = True) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separators that do.

    Work is kept on an explicit stack, so depth doesn't matter; pieces that no separator cuts small enough are cut
    between characters.
    """
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the chunk size")
    out: list[str] = []
    todo: list[tuple[str | list[str], tuple[str, ...]]] = [(text, separators)]
    while todo:
        item, left = todo.pop()
        if isinstance(item, list):
            out += _packed(item, size, overlap)
            continue
        at = next((i for i, s in enumerate(left) if not s or re.search(re.escape(s) if plain else s, item)), len(left) - 1)
        separator, finer = left[at], left[at + 1 :]
        steps: list[tuple[str | list[str], tuple[str, ...]]] = []
        run: list[str] = []
        for piece in _pieces(item, re.escape(separator) if plain else separator):
            if len(piece) < size or not finer:
                run.append(piece)
                continue
            if run:
                steps.append((run, ()))
                run = []
            steps.append((piece, finer))
        if run:
            steps.append((run, ()))
        todo += reversed(steps)
    return out


def recursive_chunks(text: Column, size: int = 1000, overlap: int = 0) -> Column:
    """:func:`split_text` of a column; null gives no chunks."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    return cut(text)


def markdown_chunks(text: Column, size: int = 1000, overlap: int = 0) -> Column:
    """Chunks of Markdown: headings, fences and rules are the coarsest separators."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap, MARKDOWN, plain=False) if t else [])

    return cut(text)
