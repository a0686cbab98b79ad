"""The queries of this subpackage, with production parameters over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard.llm.common import table
from chunkyard.llm.exact_dedup import exact_groups
from chunkyard.llm.html_extract import extract_main_text
from chunkyard.llm.language_id import identify_languages, judged_languages
from chunkyard.llm.license_scan import scan_licenses
from chunkyard.llm.mixing import mix_sources
from chunkyard.llm.packing import pack_documents
from chunkyard.llm.simhash import near_groups
from chunkyard.llm.substring_dedup import substring_dedup
from chunkyard.llm.topk_search import topk_search
from chunkyard.llm.warc import warc_roundtrip

#: Sources are grouped into domains by their number; the mixture's target weights by domain and language.
DOMAINS = (("web", 10), ("reference", 15), ("forum", 20))
MIX_WEIGHTS = {
    ("web",): 0.6, ("reference",): 0.25, ("forum",): 0.15, ("other",): 0.05,
    **{(d, x): w for d in ("web", "reference", "forum", "other") for x, w in (("en", 0.6), ("de", 0.15), ("fr", 0.15), ("es", 0.1))},
}
MIX_EPOCHS = 4


def domain(source: Column) -> Column:
    """The domain of a source by :data:`DOMAINS`; "other" for what has no number or a larger one."""
    number = F.try_to_number(F.nullif(F.regexp_extract(source, r"([0-9]{1,9})$", 1), F.lit("")), F.lit("999999999"))
    found = F.lit("other")
    for name, below in reversed(DOMAINS):
        found = F.when(number < below, F.lit(name)).otherwise(found)
    return found


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The production mixture of documents."""
    levels = {"domain": domain(F.col("source")), "language": F.col("lang"), "leaf_source": F.col("source")}
    return mix_sources(docs, levels, MIX_WEIGHTS, max_epochs=MIX_EPOCHS)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels and the base phrases' places of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents once windows of 20 words that occur before are removed."""
    return substring_dedup(table(spark, sf_dir, "documents"))


def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the components of those within three bits."""
    return near_groups(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, by equal texts without white space."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as the mixture takes them, once for each epoch."""
    taken = mixed_documents(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "domain", "language", F.col("leaf_source").alias("source"), "n_tokens", "epoch")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all other vectors for every hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search(vectors, vectors.where("vec_id % 100 = 0"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and confidence of all documents."""
    judged = judged_languages(table(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "language", "confidence", "accepted", "text_language")


def page_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language identification of web pages: declared in the markup, hinted at by the address."""
    pages = table(spark, sf_dir, "pages")
    body = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"(?is)<html[^>]*?\blang\s*=\s*[\"']?([\w-]+)", 1)
    judged = identify_languages(pages, "page_id", text=body, declared=declared, address=F.col("url"))
    return judged.select("page_id", "url", "language", "confidence", "accepted", "text_language")


def op10_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to WARC archives and read back."""
    return warc_roundtrip(table(spark, sf_dir, "pages")).drop("url")


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_hierarchical_packing": op2_hierarchical_packing,
    "op3_repeated_passages": op3_repeated_passages,
    "op4_simhash_components": op4_simhash_components,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_html_main_text": op6_html_main_text,
    "op7_source_mixture": op7_source_mixture,
    "op8_exact_topk": op8_exact_topk,
    "op9_language_id": op9_language_id,
    "op10_warc_roundtrip": op10_warc_roundtrip,
    "page_language_id": page_language_id,
}

ORACLE_SQL = {
    "op3_repeated_passages": """
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ), windows AS (
            SELECT r, doc_id, start, array_to_string(words[start:start + 19], ' ') AS said
            FROM (SELECT r, doc_id, words, unnest(range(1, len(words) - 18)) AS start FROM d)
        ), later AS (
            SELECT r, start FROM windows QUALIFY rank() OVER (PARTITION BY said ORDER BY doc_id, start) > 1
        ), word AS (
            SELECT r, unnest(words) AS word, generate_subscripts(words, 1) AS start FROM d
        ), marked AS (
            SELECT w.r, w.word, w.start,
                   coalesce(bool_or(l.r IS NOT NULL) OVER (PARTITION BY w.r ORDER BY w.start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone
            FROM word w LEFT JOIN later l USING (r, start)
        ), kept AS (
            SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY start) FILTER (NOT gone) AS kept FROM marked GROUP BY r
        )
        SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
    """,
    "op8_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT * FROM r WHERE rank <= 10
    """,
    "op10_warc_roundtrip": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), g AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest,
                   CASE WHEN octet_length(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS kept
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM kept AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to
        FROM g
    """,
    "op5_exact_dedup": """
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g
    """,
}
