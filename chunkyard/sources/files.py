"""Scans: folders of documents, golden sets, stored results."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkyard import schemas
from chunkyard.functions.text import WS

SUPPORTED = ("md", "pdf", "txt")
#: Turns the bytes of a PDF into its pages' texts. None is bundled.
PdfParser = Callable[[bytes], list[str]]


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """File names directly in a folder, through the file system that Spark uses; FileNotFoundError if there is none."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(conf)
    if not files.exists(path):
        raise FileNotFoundError(f"Folder not found: {folder}")
    return sorted(s.getPath().getName() for s in files.listStatus(path) if s.isFile())


def detect_extension(spark: SparkSession, folder: str) -> str:
    """The one supported extension in a folder, case folded; ValueError if there is none or more than one."""
    found = sorted({n.rpartition(".")[2].lower() for n in _listed(spark, folder) if "." in n} & set(SUPPORTED))
    if len(found) != 1:
        raise ValueError(f"expected files of one supported kind in {folder}, found {found}")
    return found[0]


def check_extension(spark: SparkSession, folder: str, configured: str) -> None:
    """ValueError if the folder's files are not of the configured kind."""
    if (found := detect_extension(spark, folder)) != configured:
        raise ValueError(f"{folder} holds .{found} files, but .{configured} is configured")


def load_documents(spark: SparkSession, folder: str, ext: str = "pdf", root: str = "", parse_pdf: PdfParser | None = None) -> DataFrame:
    """(source, page, text) of the files with an extension directly in a folder; one page for text files, one a page for PDF.

    ``source`` is the path below ``root``. ValueError for other kinds, FileNotFoundError for no folder or no file.
    """
    if ext not in SUPPORTED:
        raise ValueError(f"unsupported extension: {ext}")
    if not any(n.endswith(f".{ext}") for n in _listed(spark, folder)):
        raise FileNotFoundError(f"no .{ext} files in {folder}")
    path = F.regexp_replace(F.col("path"), r"^[a-z0-9]+:/+", "/")
    source = F.regexp_replace(path, f"^{root.rstrip('/')}/" if root else "^$", "").alias("source")
    if ext != "pdf":
        read = spark.read.option("pathGlobFilter", f"*.{ext}").text(folder, wholetext=True)
        return read.select("value", F.col("_metadata.file_path").alias("path")).select(source, F.lit(None).cast("int").alias("page"), F.col("value").alias("text"))
    if parse_pdf is None:
        raise ValueError("reading PDF needs a parser: parse_pdf(bytes) -> pages")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, content in zip(batch["source"], batch["content"], strict=True):
                texts = parse_pdf(bytes(content))
                yield pd.DataFrame({"source": own, "page": range(len(texts)), "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(folder)
    return files.select(source, "content").mapInPandas(pages, schemas.PAGES)


def load_golden(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The rows of a JSON-lines file with :data:`chunkyard.schemas.GOLDEN`; ValueError names a bad line.

    Blank lines are skipped, or bad if ``strict``. What follows the last line break is no line where it is empty.
    """
    raw = golden_lines(spark, path, blank=strict)
    schema = spark.createDataFrame([], schemas.GOLDEN).schema
    parsed = raw.withColumn("bad", F.expr("try_parse_json(json)").isNull())
    if bad := parsed.where("bad").select("line").orderBy("line").limit(1).collect():
        raise ValueError(f"line {bad[0]['line']} of {path} is not valid JSON")
    return parsed.select(F.from_json("json", schema).alias("row")).select("row.*")


def golden_lines(spark: SparkSession, path: str, blank: bool = False) -> DataFrame:
    """(line, json): a golden set's lines with their numbers, without blank ones unless asked for. A golden set is small: it is one text."""
    whole = spark.read.text(path, wholetext=True).where("value <> ''")
    numbered = whole.select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("at", "json"))
    return numbered.where(F.lit(blank) | (F.regexp_replace("json", WS, "") != "")).select((F.col("at") + 1).alias("line"), "json")


def load_results(spark: SparkSession, folder: str) -> DataFrame:
    """(collection, mode, n_in_corpus, scores) of stored results ``*__*.json``; of several with one key the last file counts."""
    read = spark.read.option("pathGlobFilter", "*__*.json").text(folder, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    row = F.from_json("value", "collection string, mode string, n_in_corpus int, scores map<string, double>")
    parsed = read.select("file", row.alias("r")).select("file", "r.*")
    return parsed.groupBy("collection", "mode").agg(F.max_by(F.struct("n_in_corpus", "scores"), "file").alias("x")).select("collection", "mode", "x.*")


def load_object(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The rows of one array of a JSON file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json(F.get_json_object("value", f"$.{key}"), f"array<struct<{schema}>>")).alias("row")).select("row.*")


def load_answers(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """What :func:`chunkyard.sources.reports.stored_answers` wrote: its settings, and (id, type, question, reference, contexts, answer)."""
    held = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    return held["config"], load_object(spark, path, "rows", "id string, type string, question string, reference string, contexts array<string>, answer string")


def as_json(row: dict) -> str:
    return json.dumps(row, indent=2, ensure_ascii=False)
