"""Checks of a golden set: the shape of its rows, and its quotes against pages and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import text
from chunkyard.scratch import written

# What golden rows must have.
REQUIRED = ("id", "question", "expected_answer", "source", "gold_quotes", "type", "difficulty")
TYPES = ("in_corpus", "out_of_corpus")
DIFFICULTIES = ("lexical", "paraphrased", "tabular")


def schema_errors(raw: DataFrame) -> DataFrame:
    """(line, id, errors) of golden rows given as (line, json): one row a row, errors in a fixed order.

    Missing fields end a row's checks; rows that miss some don't count as the first with their id.
    """
    field = lambda n: F.get_json_object("json", f"$.{n}")
    keys = F.coalesce(F.json_object_keys("json"), F.array().cast("array<string>"))
    rows = raw.withColumn("missing", F.filter(F.array(*map(F.lit, REQUIRED)), lambda x: ~F.array_contains(keys, x))).withColumn("id", field("id"))
    complete = F.size("missing") == 0
    seen = F.sum(complete.cast("int")).over(Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1))
    quotes, kind, tier = field("gold_quotes"), field("type"), field("difficulty")
    listed = F.coalesce(quotes.startswith("["), F.lit(False))
    held = F.coalesce(~quotes.isin("[]", ""), F.lit(False))
    q = lambda c: F.coalesce(c, F.lit("None"))
    checks = [
        F.when(F.coalesce(seen, F.lit(0)) > 0, F.concat(F.lit("duplicate id '"), q(F.col("id")), F.lit("'"))),
        F.when(~F.coalesce(kind.isin(*TYPES), F.lit(False)), F.concat(F.lit("type '"), q(kind), F.lit(f"' not in {list(TYPES)}"))),
        F.when(~F.coalesce(tier.isin(*DIFFICULTIES), F.lit(False)), F.concat(F.lit("difficulty '"), q(tier), F.lit(f"' not in {list(DIFFICULTIES)}"))),
        F.when(~listed, F.lit("gold_quotes must be a list, even when it holds one quote")),
        F.when((kind == "out_of_corpus") & held, F.lit("out_of_corpus entry must have empty gold_quotes")),
        F.when((kind == "in_corpus") & ~held, F.lit("in_corpus entry has no gold_quotes, so it has no hit test")),
    ]
    lacking = F.array(F.concat(F.lit("missing field(s): "), F.array_join("missing", ", ")))
    return rows.select("line", "id", F.when(complete, F.array_compact(F.array(*checks))).otherwise(lacking).alias("errors"))


def quotes_of(golden: DataFrame) -> DataFrame:
    """(id, source, page, position, quote, needle): the quotes of in_corpus rows, as written and normalized."""
    rows = golden.where("type = 'in_corpus'").select("id", "source", "page", F.posexplode("gold_quotes").alias("position", "quote"))
    return rows.withColumn("needle", text.normalize(F.col("quote")))


#: So many distinct anchors at most travel inside the plan; more are joined.
INLINE_ANCHORS = 2000


def holding(pages: DataFrame, quotes: DataFrame, same_source: bool | None) -> DataFrame:
    """Quotes joined with the pages that hold them, of their own source, of others, or (None) of any: by a word inside the quote, so only pages with that word are searched.

    A word inside a quote, not at its edge, is a whole word of any text that holds the quote. A page is folded and searched
    for all anchors at once, and goes on with those that it has, so texts neither shuffle nor multiply by their words. Quotes of fewer than
    three words have no such word and are compared with all pages of the sources in question, without shuffling the pages.
    """
    words = F.split("needle", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    anchor = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    asked = quotes.select("id", "position", "quote", "needle", F.col("source").alias("gold_source"), F.col("page").alias("gold_page")).withColumn("anchor", anchor)
    asked = written(asked, "quotes")
    # never null, or the plan would fold every text a second time to see whether it is
    folded = pages.where("text IS NOT NULL").select("source", "page", F.coalesce(text.normalize(F.col("text")), F.lit("")).alias("folded"))
    sources = F.lit(True) if same_source is None else F.col("source") == F.col("gold_source") if same_source else F.col("source") != F.col("gold_source")
    anchors = [r[0] for r in asked.where("anchor IS NOT NULL").select("anchor").distinct().limit(INLINE_ANCHORS + 1).collect()]
    every = F.split("folded", " ")
    if len(anchors) <= INLINE_ANCHORS:  # few words pass, and those alone are made distinct
        spread = folded.withColumn("word", F.explode(F.array_distinct(F.filter(every, lambda w: w.isin(anchors)))))
    else:  # light rows find the pages of each anchor, then those pages' texts
        light = written(folded.select("source", "page", F.explode(F.array_distinct(every)).alias("word")).join(asked.select(F.col("anchor").alias("word")).distinct(), "word", "left_semi"), "anchors")
        spread = folded.join(light.distinct(), ["source", "page"])
    long = spread.join(asked.where("anchor IS NOT NULL"), (F.col("word") == F.col("anchor")) & sources & F.contains("folded", F.col("needle")))
    columns = ["id", "position", "quote", "needle", "gold_source", "gold_page", "source", "page"]
    if not asked.where("anchor IS NULL").limit(1).count():
        return long.select(columns)
    short = folded.join(asked.where("anchor IS NULL"), sources & F.contains("folded", F.col("needle")))
    return long.select(columns).unionByName(short.select(columns))


def found_pages(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, position, pages): the pages of its own source that hold each quote, sorted; empty if none does."""
    found = holding(pages, quotes, True).groupBy("id", "position").agg(F.array_sort(F.collect_set(F.col("page").cast("long"))).alias("pages"))
    return quotes.select("id", "position").join(found, ["id", "position"], "left").withColumn("pages", F.coalesce("pages", F.array().cast("array<long>")))


def straddling(pages: DataFrame, chunks: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, position) of quotes that a page holds and no chunk of the source does."""
    whole = holding(chunks.withColumnRenamed("chunk_index", "page") if "page" not in chunks.columns else chunks, quotes, True)
    return found_pages(pages, quotes).where("size(pages) > 0").select("id", "position").join(whole.select("id", "position"), ["id", "position"], "left_anti")


def ambiguous(pages: DataFrame, quotes: DataFrame) -> DataFrame:
    """(id, position, others): quotes that pages of other sources hold, with those sources sorted."""
    return holding(pages, quotes, False).groupBy("id", "position").agg(F.array_sort(F.collect_set("source")).alias("others"))


def quote_report(golden: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, errors, warnings) of in_corpus rows; a source that isn't there, or a quote not found, ends the checks on it."""
    quotes = quotes_of(golden)
    known = pages.select("source").distinct().withColumn("known", F.lit(True))
    shown = text.preview(F.col("quote"), 55)
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    straddle = straddling(pages, chunks, quotes).withColumn("straddles", F.lit(True))
    rows = quotes.join(known, "source", "left").join(found_pages(pages, quotes), ["id", "position"]).join(straddle, ["id", "position"], "left").join(ambiguous(pages, quotes), ["id", "position"], "left")
    n_words = F.when(F.col("needle") == "", 0).otherwise(F.size(F.split("needle", " ")))
    found = F.size("pages") > 0
    errors = F.array_compact(F.array(
        F.when(~found, F.concat(F.lit("quote not found in "), base(F.col("source")), F.lit(": '"), shown, F.lit("'"))),
        F.when(F.col("straddles"), F.concat(F.lit("quote straddles a chunk boundary, unretrievable: '"), shown, F.lit("'"))),
        F.when(found & F.col("others").isNotNull(), F.concat(F.lit("quote is ambiguous, also in "), F.array_join(F.transform("others", base), ", "), F.lit(": '"), shown, F.lit("'"))),
    ))
    warnings = F.array_compact(F.array(
        F.when(n_words > config.QUOTE_WORDS, F.concat(F.lit("quote is "), n_words.cast("string"), F.lit(" words, keep to ~10-15: '"), shown, F.lit("'"))),
        F.when(found & F.col("page").isNotNull() & ~F.array_contains("pages", F.col("page").cast("long")), F.concat(F.lit("page "), F.col("page").cast("string"), F.lit(" declared but quote is on page(s) "), F.to_json("pages"), F.lit("!"))),
    ))
    absent = F.array(F.concat(F.lit("source '"), F.col("source"), F.lit("' is not in the ingested corpus")))
    checked = rows.select("id", "position", F.when(F.col("known"), errors).otherwise(F.when(F.col("position") == 0, absent).otherwise(F.array().cast("array<string>"))).alias("e"), F.when(F.col("known"), warnings).otherwise(F.array().cast("array<string>")).alias("w"))
    gathered = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", F.col(c).alias("x")))), lambda s: s.x))
    return checked.groupBy("id").agg(gathered("e").alias("errors"), gathered("w").alias("warnings"))


def exit_code(*reports: DataFrame) -> int:
    """1 if any report holds an error, else 0."""
    return int(any(r.where("size(errors) > 0").limit(1).count() for r in reports))
