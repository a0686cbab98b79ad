"""Small inputs for what the driver's tables don't hold: headings, abbreviations, golden rows with faults, stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = [
    ("a.pdf", 0, "Foreword\nArt. 1 - Scope\nfirst body"),
    ("a.pdf", 1, "continued\nArticolo 2 bis Terms\nArt.19 Requests ........ 20\nbody of two\nALLEGATO 'A'\nannex"),
    ("b.txt", 0, "art. 5 opens\ntext\n  Art.12ter x\nend"),
    ("c.txt", 0, "no heading here\nat all"),
]
HEADINGS = ["Art. 1 - Titolo", "Articolo 12 bis Titolo", "Art.12bis Titolo", "ALLEGATO 'A'", "Art. 12", "Art.12", "Art.19 Richiesta ........ 20", "Art. 33 - Cortili 29", "come da art. 5", "art. 5 del", "Article 5", "Art. 7a x"]
LABELS = ["1", "12 bis", "12bis", "allegato a", "-", "12", "-", "-", "-", "5", "-", "-"]
SENTENCES = ["D.P.R. 380 e D.Lgs. 42.", "vedi art. 5 e n. 3.", "alto m. 2,10 circa.", "un <DOT> vero.", "fine. Altro art.5"]
MARKED = ["D<DOT>P<DOT>R<DOT> 380 e D<DOT>Lgs<DOT> 42.", "vedi art<DOT> 5 e n<DOT> 3.", "alto m<DOT> 2,10 circa.", "un <DOT> vero.", "fine. Altro art.5"]
GOLDEN = [
    '{"id":"q1","question":"x","expected_answer":"y","source":"a","gold_quotes":["q"],"type":"in_corpus","difficulty":"lexical"}',
    '{"id":"q1","question":"x","expected_answer":"y","source":"a","gold_quotes":["q"],"type":"in_corpus","difficulty":"lexical"}',
    '{"id":"q2","question":"x","source":"a","gold_quotes":[],"type":"in_corpus"}',
    '{"id":"q2","question":"x","expected_answer":"y","source":"a","gold_quotes":[],"type":"in_corpus","difficulty":"hard"}',
    '{"id":"q3","question":"x","expected_answer":"y","source":"","gold_quotes":["q"],"type":"out_of_corpus","difficulty":"tabular"}',
    '{"id":"q4","question":"x","expected_answer":"y","source":"","gold_quotes":"q","type":"other","difficulty":"lexical"}',
]
GOLDEN_ERRORS = [
    "", "duplicate id 'q1'", "missing field(s): expected_answer, difficulty",
    "difficulty 'hard' not in ['lexical', 'paraphrased', 'tabular']; in_corpus entry has no gold_quotes, so it has no hit test",
    "out_of_corpus entry must have empty gold_quotes", "type 'other' not in ['in_corpus', 'out_of_corpus']; gold_quotes must be a list, even when it holds one quote",
]
RESULTS = [("dense", "hit@1", 0.25), ("dense", "hit@3", 0.5), ("dense", "hit@5", 0.75), ("dense", "hit@20", 1.0), ("dense", "mrr", 0.4375), ("bm25", "hit@1", 0.125), ("bm25", "mrr", 0.25)]


def pages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PAGES, "source string, page int, text string")


def headings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(HEADINGS)), "id int, line string")


def sentences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SENTENCES)), "id int, text string")


def golden_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(GOLDEN)), "line int, json string")


def results(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RESULTS, "mode string, metric string, value double")
