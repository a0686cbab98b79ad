"""Command line: ingest, ask, chat, evaluate, generate, judge, validate, probe, tables, inspect."""

from __future__ import annotations

import argparse
import importlib
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.operators import answering, chunking, cleaning, metrics, models, profile, retrieval, validation
from chunkyard.session import session
from chunkyard.sources import collections, files, reports

#: Stand-in for an embedding model; a real one takes its place here.
EMBED = models.hashed_embedder(256)


#: Settings of stored answers; they don't follow the command line, so that answers stay comparable.
ANSWER_MODE, ANSWER_K = "dense", 3
ANSWERS, JUDGED = "{collection}_{mode}_answers.json", "{collection}_{mode}_{judge}_judged.json"


def _raw(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Repaired pages of a folder; PDF goes through the function that ``--pdf-parser module:function`` names."""
    parser = None
    if args.pdf_parser:
        module, _, name = args.pdf_parser.partition(":")
        parser = getattr(importlib.import_module(module), name)
    pages = files.load_documents(spark, args.data, args.ext or files.detect_extension(spark, args.data), parse_pdf=parser)
    return cleaning.repair(pages).drop("repaired").withColumn("page", F.coalesce("page", F.lit(0)))


def _pages(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return cleaning.strip_furniture(_raw(spark, args))


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    """Folder to collection: repair, furniture, chunks, ids, vectors. ValueError if the folder isn't of the kind that is asked for."""
    if args.ext:
        files.check_extension(spark, args.data, args.ext)
    ext = args.ext or files.detect_extension(spark, args.data)
    chunks = chunking.split(_pages(spark, args), args.strategy, ext, EMBED).withColumn("vector", EMBED(F.col("text")))
    name = config.collection_name(args.strategy, ext)
    collections.write(chunks, args.db, name)
    print(f"{name}: {collections.read(spark, args.db, name).count()} chunks")
    return 0


def _answer(spark: SparkSession, args: argparse.Namespace, question: str, history: Sequence = ()) -> Row:
    """One turn's answer, sources and new history."""
    chunks = collections.read(spark, args.db, args.collection)

    def search(asked: DataFrame) -> DataFrame:
        return retrieval.retrieve(chunks, asked.withColumn("vector", EMBED(F.col("text"))), args.k, args.mode)

    turn = spark.createDataFrame([("q", question, list(history))], "query_id string, text string, history array<struct<role string, text string>>")
    return answering.converse(turn, search).first()


def ask(spark: SparkSession, args: argparse.Namespace) -> int:
    """One question."""
    row = _answer(spark, args, args.question)
    print(row["answer"])
    print("Sources: " + (", ".join(row["sources"]) or "none"))
    return 0


def chat(spark: SparkSession, args: argparse.Namespace) -> int:
    """Questions from standard input until !q or !quit, each with the turns before it; blank lines are skipped."""
    history: Sequence = ()
    for line in sys.stdin:
        question = line.strip()
        if question in ("!q", "!quit"):
            break
        if question:
            row = _answer(spark, args, question, history)
            history = row["history"]
            print(row["answer"], "Sources: " + (", ".join(row["sources"]) or "none"), sep="\n")
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Golden set against a collection: tables, misses, separability, stored results."""
    golden = files.load_golden(spark, args.golden, strict=True).cache()
    chunks = collections.read(spark, args.db, args.collection)
    asked = golden.select(F.col("id").alias("query_id"), F.col("question").alias("text")).withColumn("vector", EMBED(F.col("text")))
    ranked = retrieval.retrieve(chunks, asked, max(config.EVAL_KS), args.mode, apply_threshold=False).cache()
    scores = metrics.scores(metrics.per_question(ranked, golden)).cache()
    spread = metrics.score_distribution(ranked, golden).cache()
    text = reports.report(scores, args.collection, args.mode)
    print(text)
    for row in metrics.misses(ranked, golden).orderBy("id").collect():
        print(f"miss {row['id']} [{row['difficulty']}] from {row['top']}: {row['question']}")
    record = reports.payload(scores, spread, args.collection, args.mode, golden.count())
    print(reports.threshold_report(record))
    print(reports.save_results(args.results, record, text))
    return 0


def generate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Answers to the golden set, stored or used again, and the shares of refusals."""
    golden = files.load_golden(spark, args.golden)
    settings = {"collection": args.collection, "mode": ANSWER_MODE, "k": ANSWER_K, "threshold": config.THRESHOLDS[ANSWER_MODE], "llm": args.llm}

    def make() -> DataFrame:
        asked = golden.select(F.col("id").alias("query_id"), F.col("question").alias("text")).withColumn("vector", EMBED(F.col("text")))
        return answering.answer_rows(golden, retrieval.retrieve(collections.read(spark, args.db, args.collection), asked, ANSWER_K, ANSWER_MODE))

    path = reports.filled(f"{args.results}/answers/{ANSWERS}", collection=args.collection, mode=ANSWER_MODE)
    reports.stored_answers(str(path), settings, make)
    print(metrics.checked_refusal_rates(files.load_answers(spark, str(path))[1]))
    return 0


def judge(spark: SparkSession, args: argparse.Namespace) -> int:
    """Scores of stored answers; the file is named after the settings that they were made with."""
    path = reports.filled(f"{args.results}/answers/{ANSWERS}", collection=args.collection, mode=args.mode)
    settings, rows = files.load_answers(spark, str(path))
    judged = answering.judge(rows).drop("id")
    name = JUDGED.format(collection=settings["collection"], mode=settings["mode"], judge=reports.slug(args.judge))
    print(f"{judged.count()} of {rows.count()} answers judged")
    print(reports.save_records(f"{args.results}/judged", name, judged))
    return 0


def validate(spark: SparkSession, args: argparse.Namespace) -> int:
    """Golden set's shape and quotes; 1 if there is any error."""
    shape = validation.schema_errors(files.golden_lines(spark, args.golden))
    if code := validation.exit_code(shape):
        shape.where("size(errors) > 0").show(truncate=False)
        return code
    pages = _pages(spark, args).cache()
    report = validation.quote_report(files.load_golden(spark, args.golden), pages, chunking.split(pages, args.strategy, args.ext or "pdf", EMBED)).cache()
    report.where("size(errors) + size(warnings) > 0").show(truncate=False)
    return validation.exit_code(report)


def probe(spark: SparkSession, args: argparse.Namespace) -> int:
    """Profile of a folder; 2 if it can't be read, 1 if a source has problems."""
    try:
        pages = _raw(spark, args)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    found = profile.corpus_profile(pages).cache()
    found.show(truncate=False)
    print(profile.totals(found).first().asDict())
    return int(found.where("size(problems) > 0").limit(1).count() > 0)


def tables(spark: SparkSession, args: argparse.Namespace) -> int:
    """Stored results by mode for one collection, and by collection for one mode; 1 if there are none."""
    stored = files.load_results(spark, args.results).cache()
    if stored.isEmpty():
        print(f"no results in {args.results}", file=sys.stderr)
        return 1
    counts = stored.agg(F.array_sort(F.collect_set("n_in_corpus"))).first()[0]
    print(f"in_corpus questions: {counts}" + " <- mixed" * (len(counts) > 1))
    values = stored.select("collection", "mode", F.explode("scores").alias("metric", "value"))
    table = metrics.comparison(values.where(F.col("collection") == args.collection))
    rows = {r["mode"]: tuple(r) for r in table.collect()}
    print(reports.markdown_table(table.columns, [rows[m] for m in config.MODES]), end="\n\n")
    table = metrics.by_collection(values, args.mode)
    found = table.collect()
    sizes = {r["collection"]: tuple(collections.stats(collections.read(spark, args.db, r["collection"])).first()) for r in found}
    print(reports.markdown_table([*table.columns, "chunks", "mean chars"], [(*r, *sizes[r["collection"]]) for r in found]))
    return 0


def inspect(spark: SparkSession, args: argparse.Namespace) -> int:
    """What a store holds."""
    for row in collections.inspect(spark, args.db):
        print(f"{row['name']}: {row['count']} chunks, first {row['first']}")
    return 0


COMMANDS = {f.__name__: f for f in (ingest, ask, chat, evaluate, generate, judge, validate, probe, tables, inspect)}


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="chunkyard", description=__doc__)
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--data", default="data")
    parser.add_argument("--ext", choices=files.SUPPORTED)
    parser.add_argument("--db", default="db")
    parser.add_argument("--strategy", choices=config.STRATEGIES, default="base")
    parser.add_argument("--collection", default="base_1000_0_pdf_e3s")
    parser.add_argument("--mode", choices=config.MODES, default="dense")
    parser.add_argument("--k", type=int, default=3)
    parser.add_argument("--question", default="")
    parser.add_argument("--golden", default="golden.jsonl")
    parser.add_argument("--results", default="results")
    parser.add_argument("--llm", default="echo", help="name stored with generated answers")
    parser.add_argument("--judge", default="shared-words", help="name in the file of judged answers")
    parser.add_argument("--pdf-parser", help="module:function from a PDF's bytes to its pages' texts")
    args = parser.parse_args(argv)
    return COMMANDS[args.command](spark or session(), args)


if __name__ == "__main__":
    sys.exit(main())
