"""Queries by name: each takes (spark, sf_dir) and runs an operator over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import text
from chunkyard.operators import answering, chunking, cleaning, dense, fusion, lexical, metrics, models, profile, retrieval, validation
from chunkyard.plans import fixtures
from chunkyard.plans import surrogates as s
from chunkyard.scratch import written
from chunkyard.sources import collections

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _digest(c) -> F.Column:
    return F.sha2(c, 256)


@query
def hit_recall_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.per_question(s.ranked(spark, sf_dir), s.golden(spark, sf_dir))
    return rows.select("id", "difficulty", *[F.round(F.col(f"`{m}@{k}`"), 6).alias(f"{m}_{k}") for m in ("hit", "recall") for k in config.EVAL_KS], F.round("rr", 6).alias("rr"))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = text.normalize(F.col("text"))
    return s.table(spark, sf_dir, "documents").select("doc_id", _digest(folded).alias("sha"), F.length(folded).cast("long").alias("n"))


@query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = text.tokenize(F.col("text"))
    return s.table(spark, sf_dir, "documents").select("doc_id", F.size(tokens).cast("long").alias("n"), _digest(F.array_join(tokens, " ")).alias("sha"))


@query
def line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.page_lines(s.pages(spark, sf_dir)).groupBy("source", "key").agg(F.count(F.lit(1)).alias("n"))


@query
def page_furniture_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.page_furniture(s.pages(spark, sf_dir), 0.8)


@query
def page_furniture_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.page_furniture(s.pages(spark, sf_dir), 0.1)


@query
def furniture_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaning.strip_furniture(s.pages(spark, sf_dir), 0.1)
    return rows.select("source", "page", F.length("text").cast("long").alias("n"), _digest(F.col("text")).alias("sha"))


@query
def join_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.join_pages(s.pages(spark, sf_dir)).select("source", "n_pages", _digest(F.col("text")).alias("sha"))


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.with_ids(s.pages(spark, sf_dir), "page", block=chunking.page_block()).select("chunk_id", "source", "page", "chunk_index")


@query
def article_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.article_sections(fixtures.pages(spark)).select("source", F.col("section").cast("long").alias("section"), "article", "text")


@query
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.headings(spark).select("id", F.coalesce(text.heading_label(F.col("line")), F.lit("-")).alias("label"), text.is_contents_line(F.col("line")).alias("contents"))


@query
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = text.protect_abbreviations(F.col("text"))
    return fixtures.sentences(spark).select("id", marked.alias("marked"), text.restore_abbreviations(marked).alias("restored"))


@query
def semantic_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = s.table(spark, sf_dir, "embeddings").select(F.col("label").alias("source"), F.col("vec_id").alias("position"), F.col("embedding").alias("vector"))
    return chunking.semantic_breaks(rows).select("source", "position", F.round("distance", 6).alias("distance"), "group_no")


@query
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.corpus_profile(s.pages(spark, sf_dir)).withColumn("problems", F.array_join("problems", "; "))


@query
def corpus_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.totals(profile.corpus_profile(s.pages(spark, sf_dir)))


@query
def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_pages(s.pages(spark, sf_dir)).select("source", "page", F.col("n_chars").cast("long").alias("n_chars"), "short_ratio", F.col("numbers").cast("long").alias("numbers"), "is_table")


@query
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build(s.chunks(spark, sf_dir))
    return index.vocabulary.crossJoin(F.broadcast(index.totals)).select("token", "df", F.round("idf", 6).alias("idf"), "n", F.round("avgdl", 6).alias("avgdl"))  # one row


@query
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(lexical.build(s.chunks(spark, sf_dir)), s.questions(spark, sf_dir), 10)


def _vectors(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return s.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(name), F.col("embedding").alias("vector"))


@query
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.top_k(_vectors(spark, sf_dir, "chunk_id"), _vectors(spark, sf_dir, "query_id").where("query_id % 50 = 0"), 10)


@query
def dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_topk(spark, sf_dir).where(F.col("score") >= config.THRESHOLDS["dense"])


@query
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = s.questions(spark, sf_dir)
    vectors = _vectors(spark, sf_dir, "query_id").join(asked.select("query_id"), "query_id")
    near = dense.top_k(_vectors(spark, sf_dir, "chunk_id"), vectors, config.CANDIDATES)
    return fusion.rrf([near, lexical.top_k(lexical.build(s.chunks(spark, sf_dir)), asked, config.CANDIDATES)], k=config.CANDIDATES)


@query
def rerank_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank(rrf_hybrid(spark, sf_dir), s.questions(spark, sf_dir), s.chunks(spark, sf_dir, spread=False), models.shared_words_scorer, 10)


@query
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hits(s.ranked(spark, sf_dir), s.golden(spark, sf_dir)).select("id", "rank", "chunk_id", F.size("found").cast("long").alias("n_found"))


@query
def by_tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.scores(metrics.per_question(s.ranked(spark, sf_dir), s.golden(spark, sf_dir)))
    return rows.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "n", *[F.col(f"`{m}@{k}`").alias(f"{m}_{k}") for m in ("hit", "recall") for k in config.EVAL_KS], "mrr")


@query
def misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.misses(s.ranked(spark, sf_dir), s.golden(spark, sf_dir)).withColumn("top", F.array_join("top", ","))


@query
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.score_distribution(s.ranked(spark, sf_dir), s.golden(spark, sf_dir))


@query
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.separability(score_distribution(spark, sf_dir))


@query
def refusal_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("id") % 3 == 0, F.lit("Sorry: I COULD  NOT find\nany relevant information.")).otherwise(F.col("question"))
    return metrics.refusal_rates(s.golden(spark, sf_dir).select("type", said.alias("answer")))


def _history(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    rows = answering.history_window(s.table(spark, sf_dir, "conversations"), size)
    said = F.array_join(F.transform("history", lambda m: F.concat_ws(":", m.role, m.text)), "\n")
    return rows.select("conv_id", "turn", F.size("history").cast("long").alias("n"), _digest(said).alias("sha"))


@query
def chat_history_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, config.HISTORY_MESSAGES)


@query
def chat_history_window_4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir, 4)


@query
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answering.contexts(s.ranked(spark, sf_dir, 3))
    return rows.select("query_id", F.size("contexts").cast("long").alias("n"), _digest(F.col("context")).alias("sha"))


@query
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.distinct_sources(s.ranked(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


def _quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.quotes_of(s.golden(spark, sf_dir))


@query
def quote_found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.found_pages(s.pages(spark, sf_dir), _quotes(spark, sf_dir)).select("id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query
def quote_straddles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, quotes = s.pages(spark, sf_dir), _quotes(spark, sf_dir)
    # a line is part of its page and line ends are white space, so lines that hold a quote are those of pages that hold it
    found = written(validation.holding(pages, quotes, True).select("source", F.col("page").alias("found")).distinct(), "found")
    own = pages.join(found, (pages.source == found.source) & pages.page.eqNullSafe(found.found), "left_semi")
    lines = cleaning.page_lines(own).select("source", "page", F.col("line").alias("text"))
    return validation.straddling(pages, lines, quotes).select("id")


@query
def quote_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.ambiguous(s.pages(spark, sf_dir), _quotes(spark, sf_dir)).select("id", F.array_join("others", ",").alias("others"))


@query
def golden_schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.schema_errors(fixtures.golden_lines(spark)).select("line", F.array_join("errors", "; ").alias("errors"))


@query
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collections.stats(s.chunks(spark, sf_dir))


@query
def mode_table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.comparison(fixtures.results(spark))
    return rows.select("mode", *[F.col(f"`{m}`").alias(m.replace("@", "_")) for m in rows.columns if m != "mode"])


@query
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(s.pages(spark, sf_dir).withColumn("page", F.col("page").cast("int")), "base")


@query
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split(s.pages(spark, sf_dir).withColumn("page", F.col("page").cast("int")), "overlap")


@query
def markdown_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    said = F.array_join(F.transform(turns, lambda m: F.concat(F.lit("\n## "), m.role, F.lit("\n---\n"), m.text, F.lit("\n\n"))), "")
    rows = s.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("text"))
    return chunking.split(rows.select(F.lit("conversations").alias("source"), F.col("conv_id").cast("int").alias("page"), "text"), "base", ext="md")


@query
def mojibake_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    rows = s.pages(spark, sf_dir).withColumn("text", broken)
    return cleaning.repair(rows).select("source", "page", "repaired", _digest(F.col("text")).alias("sha"))
