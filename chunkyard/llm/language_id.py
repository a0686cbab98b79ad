"""Language identification by Bayesian fusion of independent evidence.

The posterior of each language adds up, in logarithms: the likelihood of the text's byte trigrams; what the markup
declares; what the address hints at, by country suffix or a leading path segment; and a prior of the host. Host priors come from
one grouped aggregation over all rows, each host smoothed towards its domain and each domain towards the whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import slices, texts_of, written

#: Rows of each label that the text model is fitted on, drawn by hash; everything else covers all rows.
SAMPLE_ROWS = 5000
#: Labels with fewer rows in the whole table than this are no classes.
MIN_ROWS = 5
#: A task of the fit sums up so many languages at once (32 MB).
HELD_LANGUAGES = 64
BUCKETS = 1 << 16
#: Trigrams overlap: three count as one piece of evidence, and no text counts for more than so many.
OVERLAP, MOST_GRAMS = 3.0, 300
#: How often a declaration or an address tells the truth.
DECLARED_TRUE, ADDRESS_TRUE = 0.85, 0.7
#: Rows that a host, or a domain, is worth in advance.
SMOOTHING = 20.0
#: Prior of a text in none of the languages, whose trigrams are taken as uniform.
OTHER_PRIOR = 0.001
UNKNOWN = "und"

# Country suffixes that hint at a language.
SUFFIXES = {
    "at": "de", "de": "de", "li": "de", "au": "en", "ie": "en", "nz": "en", "uk": "en", "us": "en", "ar": "es", "cl": "es", "co": "es", "es": "es", "mx": "es",
    "pe": "es", "fr": "fr", "it": "it", "nl": "nl", "pl": "pl", "br": "pt", "pt": "pt", "se": "sv", "dk": "da", "no": "no", "fi": "fi", "cz": "cs", "ru": "ru", "jp": "ja", "cn": "zh",
}

_LETTERS = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of a text's letters, lower-cased, words between single spaces."""
    line = b" ".join(text.lower().encode().translate(_LETTERS).split())
    if not line:
        return np.zeros(0, np.uint32)
    x = np.frombuffer(b" " + line + b" ", np.uint8).astype(np.uint32)
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)


def host_of(address: Column) -> Column:
    """The host of an address; what has no scheme stands for itself. Lower case; null stays null."""
    host = F.regexp_extract(F.lower(address), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]+)", 1)
    return F.when(host != "", host).otherwise(F.lower(address))


def domain_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def address_hint(address: Column) -> Column:
    """The language that an address hints at, by a leading path segment of two letters or the country suffix; else null."""
    path = F.regexp_extract(F.lower(address), r"^[^/]*//[^/]+/([a-z]{2})(?:[/?#]|$)", 1)
    suffix = F.regexp_extract(host_of(address), r"\.([a-z]{2})$", 1)
    table = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.when(path != "", path).otherwise(F.try_element_at(table, suffix))


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, lower case; null where there is none."""
    tag = F.regexp_extract(F.lower(F.trim(declared)), r"^([a-z]{2,3})(?:[-_]|$)", 1)
    return F.when(tag != "", tag)


class TextModel:
    """Logarithms of trigram probabilities by language, fitted on a bounded sample of labelled rows."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table

    @classmethod
    def fit(cls, df: DataFrame, text: Column, label: Column, key: Column, sample_rows: int = SAMPLE_ROWS) -> TextModel:
        """Classes are the labels of at least :data:`MIN_ROWS` of all rows; each is fitted on about ``sample_rows`` of its own, or on all if it has no more.

        Counts are aggregated where the sample lies; languages times :data:`BUCKETS` sums reach the driver.
        """
        labelled = df.select(text.alias("text"), label.alias("label"), key.alias("key")).where("label IS NOT NULL")
        rows = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {MIN_ROWS}").collect()}
        languages = sorted(rows)
        if not languages:
            return cls([], np.zeros((BUCKETS, 1), np.float32))
        most = [(1 << 64) * sample_rows // rows[x] - (1 << 63) if rows[x] > sample_rows else (1 << 63) - 1 for x in languages]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[str, np.ndarray] = {}

            def out() -> Iterator[pa.RecordBatch]:
                for name, s in sums.items():
                    at = np.nonzero(s)[0]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(s[at])], names=["label", "bucket", "n"])
                sums.clear()

            for batch in slices(batches, 0):
                for t, name in zip(texts_of(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                    if name not in sums and len(sums) >= HELD_LANGUAGES:
                        yield from out()
                    sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                    sums[name] += np.bincount(trigrams(t), minlength=BUCKETS)
            yield from out()

        bounds = F.create_map(*[F.lit(x) for pair in zip(languages, most, strict=True) for x in pair])
        sample = labelled.where(F.col("key") <= F.try_element_at(bounds, F.col("label"))).select("text", "label")
        summed = sample.mapInArrow(count, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
        at = {x: i for i, x in enumerate(languages)}
        counts = np.zeros((BUCKETS, len(languages)), np.float32)
        for r in summed.toLocalIterator():
            counts[r["bucket"], at[r["label"]]] = r["n"]
        table = np.empty((BUCKETS, len(languages) + 1), np.float32)
        table[:, -1] = -math.log(BUCKETS)
        for i in range(len(languages)):
            smooth = counts[:, i].astype(np.float64) + 0.05
            table[:, i] = np.log(smooth / smooth.sum())
        return cls(languages, table)

    def scores(self, text: str) -> list[float]:
        """Per language, and last for none of them, the log-likelihood that counts; then the number of trigrams."""
        grams = trigrams(text)
        total = np.zeros(self.table.shape[1])
        for i in range(0, len(grams), 1 << 18):
            total += self.table[grams[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
        if len(grams):
            total *= min(len(grams), MOST_GRAMS) / OVERLAP / len(grams)
        return [*total.tolist(), float(len(grams))]

    def column(self, df: DataFrame, text: Column) -> Column:
        """:meth:`scores` of a text column, as an array of doubles."""
        held = df.sparkSession.sparkContext.broadcast((self.languages, self.table))  # 256 KB a language

        @F.arrow_udf("array<double>")
        def scored(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model = TextModel(*held.value)
            for column in texts:
                yield pa.array([model.scores("" if t is None else t) for t in (x.as_py() for x in column)], pa.list_(pa.float64()))

        return scored(text)


def _host_priors(df: DataFrame, languages: list[str]) -> DataFrame:
    """(host, prior): log-probabilities for each host, from (host, language) of all rows by their texts alone."""
    counts = [F.count_if(F.col("language") == x) for x in languages]
    hosts = df.groupBy("host").agg(F.array(*counts).alias("n")).withColumn("domain", domain_of(F.col("host")))
    hosts = written(hosts, "hosts")
    sums = F.array(*[F.sum(F.col("n")[i]) for i in range(len(languages))])
    whole = [x or 0 for x in hosts.agg(sums.alias("n")).first()["n"]]
    prior = F.array(*[F.lit((x + 1) / (sum(whole) + len(languages))) for x in whole])
    domains = written(hosts.groupBy("domain").agg(sums.alias("d")), "domains")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, b: a + b)
    both = hosts.join(domains, "domain").select("host", "n", "d", total("n").alias("h_all"), total("d").alias("d_all"))
    domain = lambda p, i: (F.col("d")[i] + SMOOTHING * p) / (F.col("d_all") + SMOOTHING)
    return both.select("host", F.transform(prior, lambda p, i: F.log((F.col("n")[i] + SMOOTHING * domain(p, i)) / (F.col("h_all") + SMOOTHING))).alias("prior"))


def judged_languages(
    df: DataFrame,
    id_col: str = "doc_id",
    text: Column | None = None,
    declared: Column | None = None,
    address: Column | None = None,
    min_confidence: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(id, mark, language, confidence, accepted, text_language) for every row of ``df``; cases are as in :func:`identify_languages`.

    Texts are scored once and don't shuffle: each row leaves its scores, its host and a ``mark`` of its evidence in a written
    table, from which the priors are aggregated and to which they are joined.
    """
    text = F.col("text") if text is None else text
    tag = primary(F.col("lang") if declared is None else declared)
    where = F.col("source") if address is None else address
    model = TextModel.fit(df, text, tag, F.xxhash64(F.col(id_col), text), sample_rows)
    languages = model.languages

    n = len(languages)
    known = F.array(*[F.lit(x) for x in languages]) if n else F.array().cast("array<string>")
    names = F.array(*[F.lit(x) for x in [*languages, UNKNOWN]])
    name_of = lambda scores: F.element_at(names, F.array_position(scores, F.array_max(scores)).cast("int"))
    likelihoods = F.slice("scores", 1, n)
    other = F.col("scores")[n] + math.log(OTHER_PRIOR)
    empty = F.col("scores")[n + 1] == 0
    alone = F.when(empty, F.lit(UNKNOWN)).otherwise(name_of(F.array_append(likelihoods, other)))

    seen = df.select(
        F.col(id_col).alias("id"), _mark(text, tag, where).alias("mark"), F.coalesce(host_of(where), F.lit("")).alias("host"),
        tag.alias("tag"), address_hint(where).alias("hint"), model.column(df, text).alias("scores"),
    )
    rows = written(seen.withColumn("text_language", alone), "scores")
    if n:
        priors = _host_priors(rows.select("host", F.col("text_language").alias("language")), languages)
        rows = rows.join(written(priors, "priors"), "host", "left")

    def told(evidence: Column, language: Column, truth: float) -> Column:
        unknown = evidence.isNull() | ~evidence.isin(languages)
        return F.when(unknown, F.lit(0.0)).when(evidence == language, F.lit(math.log(truth))).otherwise(F.lit(math.log((1 - truth) / max(1, n - 1))))

    prior = F.col("prior") if n else F.array().cast("array<double>")
    score = lambda x, i: F.col("scores")[i] + F.coalesce(prior[i], F.lit(0.0)) + told(F.col("tag"), x, DECLARED_TRUE) + told(F.col("hint"), x, ADDRESS_TRUE)
    rows = rows.withColumn("post", F.array_append(F.transform(known, score) if n else F.array().cast("array<double>"), other))
    top = F.array_max("post")
    mass = F.aggregate("post", F.lit(0.0), lambda a, p: a + F.exp(p - top))
    language = F.when(empty, F.lit(UNKNOWN)).otherwise(name_of(F.col("post")))
    confidence = F.when(empty, F.lit(0.0)).otherwise(F.lit(1.0) / mass)
    judged = rows.select("id", "mark", language.alias("language"), confidence.alias("confidence"), "text_language")
    return judged.select("id", "mark", "language", "confidence", ((F.col("language") != UNKNOWN) & (F.col("confidence") >= min_confidence)).alias("accepted"), "text_language")


def _mark(text: Column, tag: Column, address: Column) -> Column:
    """Tells rows with one id apart by their evidence."""
    return F.xxhash64(text, F.coalesce(tag, F.lit("")), F.coalesce(address, F.lit("")))


def identify_languages(
    df: DataFrame,
    id_col: str = "doc_id",
    text: Column | None = None,
    declared: Column | None = None,
    address: Column | None = None,
    min_confidence: float = 0.5,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``df`` with ``language``, ``confidence``, ``accepted`` and ``text_language`` (the text's evidence alone).

    ``text``, ``declared`` and ``address`` are columns of ``df``; by default text, lang and source. Rows whose declaration names
    a language are labels; each label of :data:`MIN_ROWS` rows or more is a class, fitted on a sample of about ``sample_rows`` of its rows drawn by hash. A row
    is accepted if its best language is at least ``min_confidence`` probable; of languages with equal posteriors the first by
    name is the best. Whole texts are read, however long, and count as at most :data:`MOST_GRAMS` trigrams. Texts without letters, null ones included,
    have no evidence of their own: their language is "und", their confidence 0, and they are not accepted. Null or
    unreadable declarations and addresses count as no evidence; rows without address share one host. Repeated rows are judged alike. No rows in, no
    rows out. Columns of ``df`` with the added names are replaced. Rows meet their verdicts by id and a hash of their
    evidence; they shuffle by that only if the verdicts are too many to be sent to every task.
    """
    added = ("language", "confidence", "accepted", "text_language")
    verdicts = judged_languages(df, id_col, text, declared, address, min_confidence, sample_rows)
    verdicts = written(verdicts.select(F.col("id").alias("__id"), F.col("mark").alias("__mark"), F.struct(*added).alias("__verdict")).dropDuplicates(["__id", "__mark"]), "verdicts")
    mark = _mark(F.col("text") if text is None else text, primary(F.col("lang") if declared is None else declared), F.col("source") if address is None else address)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), F.col(id_col).alias("__own"), mark.alias("__key"))
    rows = rows.join(verdicts, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__mark")))
    return rows.select(*[F.col(f"__row.`{c}`") for c in df.columns if c not in added], *[F.col(f"__verdict.{c}").alias(c) for c in added])
