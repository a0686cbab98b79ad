"""Profiles of a corpus: is there a text layer, are words apart, is there structure, how much looks like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.functions import text

# Limits of the checks.
MIN_CHARS, MAX_WORD_CHARS, MIN_FREQUENT = 200, 8, 10
SHORT_LINE, SHORT_SHARE, MIN_NUMBERS = 40, 0.6, 40
PROBLEMS = ("SCANNED (no usable text layer)", "BROKEN SPACING (gold quotes will not validate)", "NO STRUCTURE (nothing to split on)")


def table_pages(pages: DataFrame) -> DataFrame:
    """(source, page, n_chars, short_ratio, numbers, is_table): pages of mostly short lines that are dense in numbers."""
    held = F.filter(F.transform(text.lines(F.coalesce("text", F.lit(""))), text.stripped), lambda x: x != "")
    rows = pages.select("source", "page", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), held.alias("held"), text.number_count(F.coalesce("text", F.lit(""))).alias("numbers"))
    ratio = F.try_divide(F.size(F.filter("held", lambda x: F.length(x) < SHORT_LINE)), F.size("held"))
    rows = rows.withColumn("short_ratio", F.round(ratio, 6))
    return rows.select("source", "page", "n_chars", "short_ratio", "numbers", F.coalesce((F.col("short_ratio") > SHORT_SHARE) & (F.col("numbers") > MIN_NUMBERS), F.lit(False)).alias("is_table"))


def corpus_profile(pages: DataFrame) -> DataFrame:
    """One row a source. Counts are sums over pages, so no source is put together: its pages are joined by line feeds, which no
    pattern here reaches across but white space before a heading, and that only skips blank lines."""
    body = F.coalesce("text", F.lit(""))
    words = F.regexp_extract_all(body, F.lit(r"[^\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+"), F.lit(0))
    counted = pages.select(
        "source", F.length(body).cast("long").alias("n"), F.size(words).alias("words"), F.aggregate(words, F.lit(0), lambda s, w: s + F.length(w)).alias("letters"),
        F.size(F.filter(text.word_tokens(body), lambda t: t.isin(*text.FREQUENT_WORDS))).alias("frequent"), text.legal_reference_count(body).alias("refs"),
        *[text.heading_count(body, f).alias(f) for f in text.HEADING_FAMILIES],
    )
    sums = counted.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), (F.sum("n") + F.count(F.lit(1)) - 1).alias("chars"), *[F.sum(c).alias(c) for c in ("words", "letters", "frequent", "refs", *text.HEADING_FAMILIES)])
    tables = table_pages(pages).groupBy("source").agg(F.count_if("is_table").alias("table_pages"), F.sum(F.when(F.col("is_table"), F.col("n_chars")).otherwise(0)).alias("__t"), F.sum("n_chars").alias("__n"))
    rows = sums.join(tables, "source").withColumn("avg_word_len", F.col("letters") / F.greatest("words", F.lit(1))).withColumn("frequent_per_page", F.col("frequent") / F.col("pages")).withColumn("chars_per_page", F.floor(F.col("chars") / F.col("pages")))
    most = F.greatest(*text.HEADING_FAMILIES)
    problems = F.array_compact(F.array(
        F.when(F.col("chars_per_page") < MIN_CHARS, F.lit(PROBLEMS[0])),
        F.when((F.col("avg_word_len") > MAX_WORD_CHARS) & (F.col("frequent_per_page") < MIN_FREQUENT), F.lit(PROBLEMS[1])),
        F.when(most == 0, F.lit(PROBLEMS[2])),
    ))
    family = F.coalesce(*[F.when(F.col(f) == most, F.lit(f)) for f in text.HEADING_FAMILIES])
    return rows.select(
        "source", "pages", "chars", "chars_per_page", F.round("avg_word_len", 6).alias("avg_word_len"), F.round("frequent_per_page", 6).alias("frequent_per_page"), *text.HEADING_FAMILIES,
        family.alias("main_family"), F.col("refs").alias("legal_refs"), "table_pages", F.round(F.coalesce(F.try_divide(100 * F.col("__t"), F.col("__n")), F.lit(0.0)), 6).alias("table_pct"), problems.alias("problems"),
    )


def totals(profile: DataFrame) -> DataFrame:
    """One row: sources, pages, characters and what embedding them would cost in dollars, at a fifth of a tenth a million tokens."""
    return profile.agg(F.count(F.lit(1)).alias("sources"), F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.round(F.sum("chars") / 4 * 0.02 / 1e6, 6).alias("cost"))
