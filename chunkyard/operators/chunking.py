"""Chunking of pages: by size, by headings, or where meaning shifts; with ids that depend on content only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import splitters, text


def join_pages(pages: DataFrame) -> DataFrame:
    """(source, n_pages, text): a source's pages in order, joined by line feeds."""
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("source").agg(F.count(F.lit(1)).alias("n_pages"), F.array_join(F.transform(ordered, lambda p: p.text), "\n").alias("text"))


#: Pages that are numbered together: a source's pages meet in blocks of so many, never all in one task.
PAGE_BLOCK = 1024


def with_ids(pieces: DataFrame, *order: str, block: Column | None = None) -> DataFrame:
    """Chunks with ``chunk_index`` (from 0 within a source, in ``order``) and ``chunk_id``.

    ``block`` is a number that doesn't fall along ``order``. With one, rows are numbered within (source, block), and only counts
    of blocks are added up per source, so a source may hold any share of all rows.
    """
    if block is None:
        index = F.row_number().over(Window.partitionBy("source").orderBy(*order)) - 1
        return pieces.withColumn("chunk_index", index).withColumn("chunk_id", text.chunk_id(F.col("source"), F.col("chunk_index"), F.col("text")))
    rows = pieces.withColumn("__block", F.coalesce(block.cast("long"), F.lit(-1))).withColumn("__source", F.coalesce("source", F.lit(""))).repartition("__source", "__block")
    counts = rows.groupBy("__source", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select("__source", "__block", (F.sum("__n").over(Window.partitionBy("__source").orderBy("__block")) - F.col("__n")).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__source", "__block").orderBy(*order)) - 1
    numbered = rows.withColumn("__own", own).join(before, ["__source", "__block"])
    indexed = numbered.withColumn("chunk_index", (F.col("__before") + F.col("__own")).cast("int")).drop("__source", "__block", "__before", "__own")
    return indexed.withColumn("chunk_id", text.chunk_id(F.col("source"), F.col("chunk_index"), F.col("text")))


def page_block(page: str = "page") -> Column:
    return F.floor(F.col(page) / PAGE_BLOCK)


def _shaped(pieces: DataFrame) -> DataFrame:
    return pieces.select("chunk_id", "source", F.col("page").cast("int").alias("page"), F.col("article").cast("string").alias("article"), "chunk_index", "text")


def recursive(pages: DataFrame, size: int = 1000, overlap: int = 0, markdown: bool = False) -> DataFrame:
    """Chunks of at most ``size`` characters that don't cross pages."""
    cut = splitters.markdown_chunks if markdown else splitters.recursive_chunks
    pieces = pages.select("source", "page", F.posexplode(cut(F.col("text"), size, overlap)).alias("piece", "text")).withColumn("article", F.lit(None))
    return _shaped(with_ids(pieces, "page", "piece", block=page_block()))


def article_sections(pages: DataFrame) -> DataFrame:
    """(source, section, article, text): what each heading covers, across pages; text before the first is "preambolo".

    A source's lines form one window partition: sources are documents, and sections need their lines in order.
    """
    split = join_pages(pages).select("source", F.posexplode(F.split("text", "\n")).alias("position", "line"))
    marked = split.withColumn("label", text.heading_label(F.col("line")))
    running = Window.partitionBy("source").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("section", F.count("label").over(running))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x.line), "\n")
    sections = numbered.groupBy("source", "section").agg(F.coalesce(F.max("label"), F.lit("preambolo")).alias("article"), text.stripped(body).alias("text"))
    return sections.where("text <> ''")


def sources_without_headings(sections: DataFrame) -> DataFrame:
    """Sources that article chunking cannot split."""
    return sections.groupBy("source").agg(F.max("section").alias("last")).where("last = 0").select("source")


def article(pages: DataFrame, size: int = config.ARTICLE_CHARS, overlap: int = 0) -> DataFrame:
    """Chunks by headings, long ones cut further; ValueError if a source has no heading."""
    sections = article_sections(pages)
    if missing := sources_without_headings(sections).limit(1).collect():
        raise ValueError(f"No article headings found in {missing[0]['source']}.")
    pieces = sections.select("source", "section", "article", F.posexplode(splitters.recursive_chunks(F.col("text"), size, overlap)).alias("piece", "text")).withColumn("page", F.lit(None))
    return _shaped(with_ids(pieces, "section", "piece"))


def semantic_breaks(sentences: DataFrame, percentile: float = config.PERCENTILE) -> DataFrame:
    """(source, position, distance, group_no): sentences with vectors grouped where neighbours are unusually far apart.

    ``sentences`` has source, position and vector. ``distance`` is one less the cosine to the sentence before (null for
    the first), to 9 places; a group starts where it exceeds the percentile of its source's distances.
    """
    before = Window.partitionBy("source").orderBy("position")
    paired = sentences.withColumn("__last", F.lag("vector").over(before))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    a, b = F.col("vector"), F.col("__last")
    far = paired.withColumn("distance", F.round(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 9))
    cuts = far.groupBy("source").agg(F.percentile("distance", percentile).alias("cut"))
    joined = far.join(cuts, "source").withColumn("__new", F.coalesce((F.col("distance") > F.col("cut") + 1e-12).cast("int"), F.lit(0)))
    return joined.select("source", "position", "distance", F.sum("__new").over(before.rowsBetween(Window.unboundedPreceding, 0)).alias("group_no"))


def sentences(pages: DataFrame) -> DataFrame:
    """(source, position, text): sentences of joined pages; abbreviations end none."""
    joined = join_pages(pages).select("source", text.protect_abbreviations(F.col("text")).alias("text"))
    return joined.select("source", F.posexplode(F.split("text", r"(?<=[.?!])[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+")).alias("position", "text"))


def semantic(pages: DataFrame, embed: Callable[[Column], Column], percentile: float = config.PERCENTILE) -> DataFrame:
    """Chunks of neighbouring sentences; ``embed`` maps a text column (a sentence with its neighbours) to vectors."""
    own = sentences(pages)
    near = Window.partitionBy("source").orderBy("position").rowsBetween(-1, 1)
    vectors = own.withColumn("vector", embed(F.array_join(F.collect_list("text").over(near), " ")))
    groups = own.join(semantic_breaks(vectors, percentile), ["source", "position"])
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text), " ")
    pieces = groups.groupBy("source", "group_no").agg(text.restore_abbreviations(body).alias("text")).withColumn("page", F.lit(None)).withColumn("article", F.lit(None))
    return _shaped(with_ids(pieces, "group_no"))


def split(pages: DataFrame, strategy: str, ext: str = "pdf", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of ``pages`` by a strategy of :data:`chunkyard.config.STRATEGIES`; ValueError for others."""
    if strategy in ("base", "overlap"):
        sizes = config.STRATEGIES[strategy]
        return recursive(pages, sizes["chunk_size"], sizes["chunk_overlap"], markdown=ext == "md")
    if strategy == "article":
        return article(pages)
    if strategy == "semantic_p95":
        if embed is None:
            raise ValueError("semantic chunking needs an embedding function")
        return semantic(pages, embed)
    raise ValueError(f"Unknown chunking strategy: {strategy}")
