"""Cleaning of page text: encoding repair and removal of lines that most pages of a source share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import mojibake, text


def repair(pages: DataFrame) -> DataFrame:
    """``pages`` with misread characters repaired, and ``repaired`` telling which rows changed."""
    return pages.withColumn("__text", mojibake.fixed(F.col("text"))).withColumn("repaired", ~F.col("__text").eqNullSafe(F.col("text"))).withColumn("text", F.col("__text")).drop("__text")


def page_lines(pages: DataFrame) -> DataFrame:
    """(source, page, position, line, key): one row a line."""
    exploded = pages.select("source", "page", F.posexplode(text.lines(F.col("text"))).alias("position", "line"))
    return exploded.withColumn("key", text.line_key(F.col("line")))


def page_furniture(pages: DataFrame, share: float = config.FURNITURE_SHARE, min_chars: int = config.FURNITURE_CHARS, min_pages: int = 1) -> DataFrame:
    """(source, key, cnt, n_pages) of lines that at least ``share`` of a source's pages hold.

    Lines count once a page, and only if they have ``min_chars`` characters. Sources of fewer than ``min_pages`` pages are
    left alone; by default every long line of a single page counts as furniture.
    """
    per_page = pages.select("source", "page", F.explode(F.array_distinct(F.transform(F.filter(text.lines(F.col("text")), lambda x: F.length(text.stripped(x)) >= min_chars), text.line_key))).alias("key"))
    counts = per_page.groupBy("source", "key").agg(F.count(F.lit(1)).alias("cnt"))
    totals = pages.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"))
    return counts.join(totals, "source").where((F.col("cnt") >= share * F.col("n_pages")) & (F.col("n_pages") >= min_pages)).select("source", "key", "cnt", "n_pages")


def strip_furniture(pages: DataFrame, share: float = config.FURNITURE_SHARE, min_chars: int = config.FURNITURE_CHARS, min_pages: int = 1) -> DataFrame:
    """``pages`` without furniture lines, short ones with the same key included.

    A source's furniture is few lines: it comes to its pages as one list, so no page is taken apart and put together.
    """
    found = page_furniture(pages, share, min_chars, min_pages).groupBy("source").agg(F.collect_set("key").alias("__keys"))
    kept = F.filter(text.lines(F.col("text")), lambda x: ~F.array_contains(F.col("__keys"), text.line_key(x)))
    joined = pages.join(found, "source", "left")
    return joined.withColumn("text", F.when(F.col("__keys").isNull(), F.array_join(text.lines(F.col("text")), "\n")).otherwise(F.array_join(kept, "\n"))).select(pages.columns)
