"""Text functions, splitting and repair."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chunkyard import config
from chunkyard.functions import mojibake, splitters, text
from chunkyard.sources import reports


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


ODD = ["L’art. 5­ bis X", " a\u001cb\t\nc ", "", "CITTÀ", None]


def test_normalize(spark):
    want = [None if v is None else re.sub(r"\s+", " ", v.replace("’", "'").replace("­", "")).strip().lower() for v in ODD]
    assert column(spark, ODD, text.normalize) == want


def test_tokenize(spark):
    values = ["DPR 380/2001, m 3,00", "3abc m2 Città x_y", "l’uso", "", "1.2.3/4 ½ 五"]
    assert column(spark, values, text.tokenize) == [["dpr", "380/2001", "m", "3,00"], ["3", "abc", "m2", "città", "x_y"], ["l", "uso"], [], ["1.2.3/4", "½", "五"]]


def test_lines(spark):
    values = ["a\nb\r\nc\n", "", "\n", "a\x0bb\x0cc\x1cd\x85e f", "x", "\n\n", "a\r\rb"]
    assert column(spark, values, text.lines) == [v.splitlines() for v in values]


def test_line_key_and_preview(spark):
    assert column(spark, ["  Pagina 10/120  ", "A" * 80, "x  1 2"], text.line_key) == ["pagina #/#", "a" * 60, "x # #"]
    assert column(spark, ["x" * 55, "x" * 56], lambda c: text.preview(c, 55)) == ["x" * 55, "x" * 55 + "..."]


def test_chunk_id(spark):
    rows = [("a", 0, "é"), (None, 1, "é"), ("a", 1, "é")]
    got = spark.createDataFrame(rows, "s string, i int, t string").select(text.chunk_id(F.col("s"), F.col("i"), F.col("t"))).collect()
    assert [r[0] for r in got] == [hashlib.sha256(f"{s or 'unknown'}|{i}|{t}".encode()).hexdigest()[:16] for s, i, t in rows]


def test_refused(spark):
    assert column(spark, [config.NO_CONTEXT, "COULD not\n find any  relevant information", "found", ""], text.refused) == [True, True, False, False]


def test_number_and_reference_counts(spark):
    values = ["1,2,3 12345 12345,6 x1 1a 7. 1.2a", "D.Lgs. 42 art. 5 art.5 comma 2 Allegato", "è1 1è 2"]
    number = re.compile(r"\b\d+[.,]\d+\b|\b\d{1,4}\b")
    assert column(spark, values, text.number_count) == [len(number.findall(v)) for v in values]
    legal = re.compile(r"(?i)\b(?:d\.?\s?lgs|d\.?p\.?r|l\.?r|d\.?m|art\.|comma|allegato)\b")
    assert column(spark, values, text.legal_reference_count) == [len(legal.findall(v)) for v in values]


def test_abbreviations_come_back(spark):
    values = ["D.P.R. 380, D.Lgs. 42 e s.m.i. fine.", "art. 5. Fine", "è.a.b. x"]
    back = column(spark, values, lambda c: text.restore_abbreviations(text.protect_abbreviations(c)))
    assert back == values


def test_abbreviations_are_marked_where_they_stand(spark):
    values = ["s.m.i. e frasixs.m.i. fine", "a.b.c. 1a.b. x_a.b. abcde.f.g. (p.i.) ab.c", "", "...", "S.p.A.\nU.S.A. a.b.\n"]
    got = column(spark, values, lambda c: F.replace(text.protect_abbreviations(c), F.lit("<DOT>"), F.lit("#")))
    acronym = re.compile(r"(?<!\w)(?:[A-Za-z]{1,4}\.){2,}")
    assert got == [acronym.sub(lambda m: m[0].replace(".", "#"), v) for v in values]


def test_source_prefix(spark):
    values = ["a/b.c_d.pdf", "x_y.txt", "plain", "dir.x/name.tar.gz", "a_b_c.md"]
    assert column(spark, values, text.source_prefix) == ["b.c", "x", "plain", "name.tar", "a"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(3, 30))
def test_chunks_fit_and_lose_no_letters(body, size):
    chunks = splitters.split_text(body, size)
    assert all(0 < len(c) <= size and c == c.strip() for c in chunks)
    assert re.sub(r"\s", "", "".join(chunks)) == re.sub(r"\s", "", body)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=1, max_size=6), max_size=40), st.integers(8, 25), st.integers(0, 7))
def test_overlapping_chunks_fit(words, size, overlap):
    body = " ".join(words)
    chunks = splitters.split_text(body, size, overlap)
    assert all(len(c) <= size for c in chunks)
    at = 0
    for c in chunks:
        assert (found := body.find(c, max(0, at - size))) >= 0
        at = found + len(c)


def test_split_text_examples():
    assert splitters.split_text("short", 100) == ["short"]
    assert splitters.split_text("aa bb cc dd", 5) == ["aa bb", "cc", "dd"]  # a separator counts with the piece that it opens
    assert splitters.split_text("aa bb cc dd", 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert splitters.split_text("one\n\ntwo three\n\nfour", 12) == ["one", "two three", "four"]
    assert splitters.split_text("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    with pytest.raises(ValueError):
        splitters.split_text("x", 5, 5)


def test_markdown_prefers_headings():
    chunks = splitters.split_text("text a\n# One\nbody one\n# Two\nbody two", 18, separators=splitters.MARKDOWN, plain=False)
    assert chunks == ["text a", "# One\nbody one", "# Two\nbody two"]


def test_fix_text(spark):
    good = ["società di ingegneria", "perché l'uso — €", "plain", "日本"]
    for t in good:
        assert mojibake.fix_text(t) == t
        assert mojibake.fix_text(t.encode().decode("latin-1")) == t
    assert mojibake.fix_text("societÃ  di") == "società di"
    assert mojibake.fix_text("ﬁne") == "fine"
    assert mojibake.fix_text("perché l’uso — €".encode().decode("cp1252")) == "perché l'uso — €"
    known = {
        "“a” ‘b’ „c‟": "\"a\" 'b' \"c\"",
        "a\r\nb\rc\u2028d\u2029e\x85f": "a\nb\nc\nd\ne\nf",
        "ＬＯＵＤ　ＮＯＩＳＥＳ": "LOUD NOISES",
        "\x1b[36;44mcold\x1b[0m\ufeff\x00 \x07tab\t": "cold tab\t",
        "a &amp; b &eacute; &#39;x&#39; &nosuch;": "a & b é 'x' &nosuch;",
        "<b>a &amp; b</b>": "<b>a &amp; b</b>",
        "e\u0301": "é",
    }
    assert {k: mojibake.fix_text(k) for k in known} == known
    assert column(spark, list(known), mojibake.fixed) == list(known.values())
    assert column(spark, ["perchÃ©", "abc", None], mojibake.fixed) == ["perché", "abc", None]


def test_names_and_tables(tmp_path):
    assert [config.collection_name(x) for x in config.STRATEGIES] == ["base_1000_0_pdf_e3s", "overlap_1000_150_pdf_e3s", "article_pdf_e3s", "semantic_p95_pdf_e3s"]
    assert reports.markdown_table(["a", "b"], [(1, None), ("x", 2)]) == "| a | b |\n| :--- | :---: |\n| 1 |  |\n| x | 2 |"
    assert reports.filled("x/{a}_{b}.json", a="1", b="2").name == "1_2.json"
    assert reports.git_state(str(tmp_path)) == "unknown"
