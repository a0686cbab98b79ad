"""Licence scan, packing, main-text extraction, WARC and language ID."""

import hashlib
import html.parser
import io
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from chunkyard.llm import license_scan, packing, warc
from chunkyard.llm.html_extract import extract_main_text, main_text
from chunkyard.llm.language_id import TextModel, address_hint, domain_of, host_of, identify_languages, primary, trigrams
from chunkyard.llm.license_scan import BASE, TEMPLATES, TokenAutomaton, scan_licenses, words_of

# --- licences


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, n_words int").repartition(3)


def brute_license(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for label, phrase in BASE.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


LICENSES = [
    (1, "Released under the MIT License. MIT-license, mit_license; mitlicense"), (2, None), (3, ""), (4, "GNU Général Public License"), (5, "the GNU General\nPublic   License, version 3 apache license"),
    (6, "mit " * 50_000 + "license"), (7, "é MIT License É"), (None, "Apache License"), (1, "Released under the MIT License. MIT-license, mit_license; mitlicense"), (8, "mit mit license general general public license"),
]


def test_license_base_places(spark):
    got = [tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in scan_licenses(docs(spark, LICENSES)).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute_license(t)) for i, t in LICENSES], key=str)
    rows = scan_licenses(docs(spark, LICENSES)).collect()
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in rows)
    assert scan_licenses(docs(spark, [])).count() == 0


def plain(template, optional, word="zz"):
    """A text that a template accepts."""
    out = re.sub(r"<<var;words=(\d+)-(\d+)>>", lambda m: " ".join([word] * int(m[2 if optional else 1])), template)
    while "<<begin" in out:
        out = re.sub(r"<<beginOptional>>((?:(?!<<).)*?)<<endOptional>>", r"\1" if optional else "", out, flags=re.S)
    return re.sub(r"\(([\w|]*\|[\w|]*)\)", lambda m: m[1].split("|")[-1 if optional else 0], out)


@pytest.mark.parametrize("label", TEMPLATES)
def test_templates_need_their_mandatory_words_only(label):
    automaton = TokenAutomaton(TEMPLATES)
    for optional in (False, True):
        text = plain(TEMPLATES[label], optional)
        assert automaton.accepts_text(text, label)
        assert automaton.labels.index(label) in {t for t, _ in automaton.matches(words_of(f"some words {text} more"))}
    words = words_of(plain(TEMPLATES[label], False))
    for i in range(len(words)):
        assert not automaton.accepts_text(b" ".join([*words[:i], b"qqq", *words[i:]]).decode(), label) or "<<" in TEMPLATES[label]
    assert not automaton.accepts_text(b" ".join(words[:-1]).decode(), label)
    fixed = next(i for i, w in enumerate(words) if i and w != b"zz")
    assert not automaton.accepts_text(b" ".join([*words[:fixed], b"qqq", *words[fixed + 1 :]]).decode(), label)


@pytest.mark.parametrize("label", [k for k in TEMPLATES if not k.endswith("-notice")])
def test_every_mandatory_word_counts(label):
    """A text with any one fixed word changed or left out, disclaimer included, is no longer the licence."""
    automaton = TokenAutomaton({label: TEMPLATES[label]})
    words = words_of(plain(TEMPLATES[label], False))
    fixed = [i for i, w in enumerate(words) if w != b"zz"]
    assert len(fixed) == automaton.mandatory[0]
    assert automaton.matches(words) and automaton.accepts_text(b" ".join(words).decode(), label)
    for i in fixed:
        for other in ([*words[:i], b"qqq", *words[i + 1 :]], [*words[:i], *words[i + 1 :]]):
            assert not automaton.matches(other) and not automaton.accepts_text(b" ".join(other).decode(), label)


def test_markup_against_regular_expressions():
    rng = random.Random(3)
    templates = {"t": "a b<<beginOptional>> c<<beginOptional>> d<<endOptional>><<endOptional>> <<var;words=1-2>> e", "u": "b (x|y) <<var;words=0-1>> a"}
    shapes = {"t": re.compile(r"a b(?: c(?: d)?)?(?: \w){1,2} e"), "u": re.compile(r"b [xy](?: \w)? a")}
    automaton = TokenAutomaton(templates)
    for _ in range(3000):
        words = [rng.choice("abcdexy") for _ in range(rng.randrange(1, 12))]
        want = {(k, i) for k, shape in shapes.items() for i in range(len(words)) if shape.match(" ".join(words[i:]) + " ", 0) and shape.match(" ".join(words[i:]))}
        got = {(automaton.labels[t], s) for t, s in automaton.matches([w.encode() for w in words])}
        assert {k for k, _ in got} == {k for k, _ in want}
        assert got <= want


def test_bad_templates():
    for bad in ("<<beginOptional>>a<<endOptional>>", "<<var;words=1-2>> a", "a <<beginOptional>>b"):
        with pytest.raises(ValueError):
            TokenAutomaton({"bad": bad})
    assert license_scan.words_of("") == []


# --- packing


PACK = [(1, "hello world, it's <|endoftext|> 123 über\n\n  x"), (2, None), (3, ""), (4, "word " * 9000), (None, "a"), (1, "hello"), (5, "日本語 \U0001f600 ½²  \t end ")] + [
    (100 + i, " ".join(f"tok{(i * 37 + j) % 911}" for j in range(i * 13 % 700))) for i in range(150)
]


def test_pack_documents(spark):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs(spark, PACK)).collect()
    want = sorted(([i, [*coder.encode(t or "", add_special_tokens=False).ids, 1]] for i, t in PACK), key=str)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert sorted((i, len(x)) for i, x in want if i is not None) == sorted(k for k in by_doc if k[0] is not None)
    for ident, ids in want:
        own = sorted(by_doc[ident, len(ids)], key=lambda p: p["start"])
        assert [p["start"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1].tolist()]
        assert sum(p["length"] for p in own) == len(ids)
        for p in own:
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        used = sum(p["length"] for p in own)
        assert [p["offset"] for p in own] == [0, *np.cumsum([p["length"] for p in own])[:-1].tolist()]
        assert used <= 2048 and used & (used - 1) == 0 and {p["tier"] for p in own} == {used}
    few = packing.pack_documents(docs(spark, PACK).coalesce(1), step_tokens=4096).collect()
    groups = {}
    for p in few:
        groups[p["step_group"]] = groups.get(p["step_group"], 0) + p["length"]
    assert len(groups) == -(-sum(groups.values()) // 4096) > 3
    assert max(groups.values()) <= 4096 and max(groups.values()) - min(groups.values()) <= 2048
    full = sum(len(own) > 0 and sum(p["length"] for p in own) in packing.TIERS for own in by_sequence.values())
    assert full > 0.8 * len(by_sequence)
    assert packing.pack_documents(docs(spark, [])).count() == 0


def test_ids_are_those_of_the_vocabulary_file():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    coder, encode = Tokenizer.from_file(path("byte_bpe_50k.json")), packing.byte_bpe()
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|endoftext", "|>", " ", "  \n", "hello", "World's", "é", "123", "\t", "日本", "\u00a0", "..", "<", "e\u0301", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000)]
    assert "<|endoftext|>" in "".join(texts)
    for text in ["hello <|endoftext|> world", *texts]:
        assert encode(text) == coder.encode(text, add_special_tokens=False).ids, text


def test_step_groups_are_balanced():
    rng = random.Random(7)
    for _ in range(200):
        sizes = [1 << rng.randrange(12) for _ in range(rng.randrange(1, 300))]
        loads = [0] * (max(dealt := packing.step_groups(sizes, 8192)) + 1)
        for s, g in zip(sizes, dealt, strict=True):
            loads[g] += s
        assert max(loads) <= 8192 and max(loads) - min(loads) <= max(sizes)


def test_packer_places_every_id_once():
    rng = random.Random(4)
    for _ in range(30):
        out = []
        packer = packing.Packer((8, 16, 32), lambda pieces, used, out=out: out.append((list(pieces), used)))
        sizes = [rng.choice([1, 3, 8, 9, 31, 32, 33, 100, rng.randrange(1, 70)]) for _ in range(rng.randrange(0, 40))]
        for i, n in enumerate(sizes):
            packer.add(i, n)
        packer.pack()
        places = sorted((d, s + j) for pieces, _ in out for d, s, n in pieces for j in range(n))
        assert places == [(i, j) for i, n in enumerate(sizes) for j in range(n)]
        assert all(sum(n for _, _, n in pieces) == used and used & (used - 1) == 0 and used <= 32 for pieces, used in out)


# --- main text

PAGES = {
    "<html><body><div id=menu><a href=x>Home</a> <a href=y>News</a></div><div class='content'><h1>Title</h1><p>Hello&nbsp;world, this is <i>nice</i>, a<br>paragraph &amp; more.</p>"
    "<form>x<input></form><p>Bye</div><section class=comments><p>A comment, really long, with commas, and so on and so on</p></section><footer>f</footer></body></html>": "Title\nHello world, this is nice, a paragraph & more.\nBye",
    "<article><h1>A</h1><p><b>Bold text here<br><p>Second, with a comma<script>var x='</p>';</script></p><aside>no</aside><div class=ad>buy</div></article><nav>n</nav>": "A\nBold text here\nSecond, with a comma",
    "": "", "just text": "just text", "<p>": "", "<!-- <p>hidden</p> --><p>shown text &lt;p&gt;</p>": "shown text <p>",
    "<body><header>Site</header><main><header><h1>Own head</h1></header><section><p>One, two, three, four, five six</p></section><section><p>Last one</p></section></main></body>": "Own head\nOne, two, three, four, five six\nLast one",
    "<style>p{}</style><title>t</title><article><ul><li>one<li>two</ul><div><ul><li><a href=1>link one</a><li><a href=2>link two</a></ul></div><p>tail text</article>": "one\ntwo\nlink one\nlink two\ntail text",
    "<article><p style='display:none'>x</p><p hidden>y</p><p>z" + " w" * 50_000 + "</p></article>": "z" + " w" * 50_000,
    "<article><p>a < b and c > d & e</p></article>": "a < b and c > d & e",
    "<div>" * 3000 + "deep, deep text" + "</div>" * 3000: "deep, deep text",
}


@pytest.mark.parametrize("page", PAGES, ids=range(len(PAGES)))
def test_main_text(page):
    assert main_text(page) == PAGES[page]


BODY = "<p>One, two, three, four, five, six words of text</p><p>And more of it, to the end of the page, as it was</p>"
TEXT = "One, two, three, four, five, six words of text\nAnd more of it, to the end of the page, as it was"
NAMED = {
    f"<body><div class='has-sidebar'>{BODY}<div class='sidebar'>aside, not this</div></div></body>": TEXT,
    f"<body><div id='page' class='layout-with-sidebar'><article>{BODY}</article></div></body>": TEXT,
    f"<body><div class='sidebar'>a menu</div><div class='widget'>{BODY}</div></body>": TEXT,
    f"<body><div class='side'><main>{BODY}</main></div><div class='ad-banner left'>buy, buy, buy this now and again</div></body>": TEXT,
    f"<article><div class='post-header'><h1>T</h1></div><h2 class='section-header'>S</h2>{BODY}<section class='related-work'><p>Others, too, wrote of this at length.</p></section></article>": f"T\nS\n{TEXT}\nOthers, too, wrote of this at length.",
    "<div class='ad'>Buy this, that, and more of it, now, and again, and again.</div><article><h1>Short</h1><p>Hm.</article>": "Short\nHm.",
    f"<body><div>{BODY}</div><div id='comments'><article class='comment'><p>{'So, so, so long a comment. ' * 40}</p></article></div></body>": TEXT,
}


RAW = {
    "<script>if(i<n) x(); // don't stop</script><p>A</p><p>It's ..</p>": "A\nIt's ..",
    f"<body><script><!-- old style\nvar a;</script><article>{BODY}</article></body></html>": TEXT,
    f"<article><style>p > a {{}} /* don't */</style>{BODY}<script>a='<p>x</p>'; b=\"</scr\"+'ipt'</script><p>end</p></article>": f"{TEXT}\nend",
    f"<article><!--><p>first</p><!-- a > b -->{BODY}</ ><p don't>last, isn't it</p><p class='x'>really</p></article>": f"first\n{TEXT}\nlast, isn't it\nreally",
    f"<article>{BODY}<a href=\"never closed>link</a><p>tail</p></article>": f"{TEXT}\nlink\ntail",
    "<p>a <": "a <", "<p>a <b": "a", "<p>text</p><!-- to the end <p>no</p>": "text",
}
WHOLE = {
    f"<body><div>{BODY}</div><p>Short.</p></body>": f"{TEXT}\nShort.",
    f"<body><article>{BODY}<div class='print'><p>Kept in print.</p></div><div class='story-notice'>Kept notice</div><p class='tags side'>Kept too</p></article></body>": f"{TEXT}\nKept in print.\nKept notice\nKept too",
    f"<body><article>{BODY}<ul><li><a href=1>Source one</a><li><a href=2>Source two</a></ul><p>End.</p></article></body>": f"{TEXT}\nSource one\nSource two\nEnd.",
    f"<body><div class='menu'><a href=1>Home</a></div><div><ul><li><a href=1>Front page</a></ul>{BODY}<ul><li><a href=1>See this</a></ul>{BODY}<ul><li><a href=2>Next page</a></ul></div></body>": f"{TEXT}\nSee this\n{TEXT}",
    f"<body><form id='aspnet'><input><nav>n</nav><article>{BODY}<form>Search <button>go</button></form></article></form></body>": TEXT,
    f"<main><h1>T</h1><article>{BODY}<div class='ad'>Buy</div><div class='share-buttons'>Tweet</div></article><section class='comments'><p>So, so</p></section></main>": f"T\n{TEXT}",
}


@pytest.mark.parametrize("page", [*RAW, *WHOLE], ids=range(len(RAW) + len(WHOLE)))
def test_raw_elements_and_whole_articles(page):
    assert main_text(page) == {**RAW, **WHOLE}[page]


class Article(html.parser.HTMLParser):
    """The text of article elements, by the library's parser: another reader of pages that mark their article."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.lines, self.now = 0, [], []

    def cut(self):
        if line := " ".join("".join(self.now).split()):
            self.lines.append(line)
        self.now = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag == "br":
            self.now.append(" ")
        elif tag in ("p", "h1", "li", "ul", "div"):
            self.cut()

    def handle_endtag(self, tag):
        if tag in ("article", "p", "h1", "li", "ul", "div"):
            self.cut()
        self.depth -= tag == "article"

    def handle_data(self, data):
        if self.depth > 0:
            self.now.append(data)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.1/pages.parquet"), reason="needs the driver's pages")
def test_main_text_of_all_pages():
    pages = pyarrow.parquet.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"]).column(0).to_pylist()
    for page in pages:
        reader = Article()
        reader.feed(page or "")
        reader.close()
        reader.cut()
        assert main_text(page or "") == "\n".join(reader.lines), page


def test_extract_main_text_of_nothing(spark):
    got = extract_main_text(spark.createDataFrame([], "page_id long, url string, html string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 0


@pytest.mark.parametrize("page", NAMED, ids=range(len(NAMED)))
def test_names_alone_take_out_no_article(page):
    assert main_text(page) == NAMED[page]


def test_extract_main_text(spark):
    rows = [(i, f"http://x/{i}", p, "t") for i, p in enumerate(PAGES)] + [(None, None, None, "t"), (0, "http://x/0", next(iter(PAGES)), "t")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)).collect()
    want = [(i, u, PAGES[p] if p is not None else "", len(PAGES[p]) if p is not None else 0) for i, u, p, _ in rows]
    assert sorted([(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got], key=str) == sorted(want, key=str)


# --- WARC


WARC_PAGES = [(1, "http://a/", "x" * 1000), (2, "http://b/ ü\r\nEvil: 1", "x" * 1000), (3, None, "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (None, "n", "x" * 1000), (7, "u", "é" * 600), (9, "u", "é" * 600), (8, "u", "é" * 600), (10, "u", "y" * 300_000), (7, "u", "é" * 600)]


def test_warc_round_trip(spark):
    df = spark.createDataFrame([(*r, "key", "r") for r in WARC_PAGES], "page_id long, url string, html string, key string, refers_to string").repartition(3)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.warc_roundtrip(df).collect()]
    want = []
    for i, _, h in WARC_PAGES:
        data = (h or "").encode()
        top = max((j for j, _, other in WARC_PAGES if other == h and j is not None), default=None) if len(data) >= 1000 else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if i == top else "revisit", None if i == top else top))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.warc_roundtrip(df.limit(0)).count() == 0


def test_archives_give_payloads_back(spark):
    df = spark.createDataFrame(WARC_PAGES[:6], "page_id long, url string, html string")
    manifest = warc.write_archives(df)
    assert sum(r["records"] for r in manifest.collect()) == 6
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, manifest, keep_payload=True).collect() if r["record_type"] == "response"}
    assert got == {2: "x" * 1000, 3: "x" * 999, 4: "x" * 999, 5: "", 6: ""}


def test_damaged_archives_raise():
    whole = warc.record(1, "http://a/", b"payload " * 99) + warc.record(2, "b", b"")
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(whole))] == [1, 2]
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(whole[:-9])))
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(b"not gzip")))

    def altered(a, b):
        return zlib.compressobj(6, zlib.DEFLATED, 31), zlib.decompress(warc.record(1, "a", b"payload"), 31).replace(a, b)

    for a, b in ((b"payload\r", b"paxload\r"), (b"Content-Length: 7\r\n\r\n", b"Content-Length: 8\r\n\r\n"), (b"\r\n\r\npayload", b"\r\n\r\npayloadd"), (b"WARC/1.1", b"WORC/1.1")):
        pack, data = altered(a, b)
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(pack.compress(data) + pack.flush())))


def test_reader_is_incremental(monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 7)
    whole = b"".join(warc.record(i, "u", bytes([65 + i]) * i * 50) for i in range(5))
    assert [r["payload_bytes"] for r in warc.read_records(io.BytesIO(whole))] == [0, 50, 100, 150, 200]


# --- language ID

WORDS = {"en": "the and of to in is that for with this from have".split(), "fr": "le la les de des et que une pour dans est avec".split(), "de": "der die das und nicht mit eine für auf ist von zu".split()}


def speech(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_addresses(spark):
    urls = ["http://m.a.example.de/fr/25?x", "https://u@Blog.Example.co.uk:80/x", "src7", None, "", "//h.es", "http://a.com/english/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u")).alias("h"), domain_of(host_of(F.col("u"))).alias("d"), address_hint(F.col("u")).alias("a"))
    assert [tuple(r) for r in df.collect()] == [("m.a.example.de", "example.de", "fr"), ("blog.example.co.uk", "co.uk", "en"), ("src7", "src7", None), (None, None, None), ("", "", None), ("h.es", "h.es", "es"), ("a.com", "a.com", None)]
    tags = spark.createDataFrame([("en-US",), (" DE ",), ("",), (None,), ("english",), ("pt_BR",)], "t string").select(primary(F.col("t")).alias("t"))
    assert [r[0] for r in tags.collect()] == ["en", "de", None, None, None, "pt"]


def test_identify_languages(spark):
    rng = random.Random(5)
    rows = [(i, speech(rng, lang := rng.choice(["en", "fr", "de"]), rng.randrange(5, 60)), lang if rng.random() < 0.9 else None, f"h{i % 4}", lang) for i in range(600)]
    rows += [(1000, None, "en", "h1", "und"), (1001, "", None, None, "und"), (1002, "123 !!", "fr", "", "und"), (None, speech(rng, "fr", 40_000), "", None, "fr"), (1003, speech(rng, "de", 30), "en", "h1", "de")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lang string, source string, truth string, confidence double").repartition(3)
    got = identify_languages(df).collect()
    assert len(got) == len(rows)
    assert sum(r["language"] == r["truth"] for r in got) >= 0.99 * len(rows)
    by = {r["doc_id"]: r for r in got}
    for i in (1000, 1001, 1002):
        assert (by[i]["language"], by[i]["confidence"], by[i]["accepted"]) == ("und", 0.0, False)
    assert by[None]["language"] == "fr" and by[None]["accepted"]
    assert by[1003]["language"] == "de"
    assert identify_languages(df.limit(0)).count() == 0


def brute_posteriors(rows):
    """(language, confidence, language by text alone) of (text, declared, address) rows, by plain counting; every label has few rows."""

    def grams(text):
        line = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").lower().encode()).split()
        x = b" " + b" ".join(line) + b" "
        return [((x[i] << 16 | x[i + 1] << 8 | x[i + 2]) * 0x9E3779B1 % 2**32) >> 16 for i in range(len(x) - 2)] if line else []

    def host(address):
        return (re.sub(r"^[a-z]+://|[:/?#].*", "", address.lower()) if "//" in address else address.lower()) if address else ""

    def hint(address):
        if path := re.match(r"[a-z]+://[^/]+/([a-z]{2})(?:[/?#]|$)", address or ""):
            return path[1]
        return {"de": "de", "fr": "fr", "uk": "en"}.get(host(address).rpartition(".")[2]) if "." in host(address) else None

    tags = [d[:2].lower() if d else None for _, d, _ in rows]
    names = sorted(x for x in set(tags) - {None} if tags.count(x) >= 5)
    counts = {x: Counter(g for (t, _, _), tag in zip(rows, tags, strict=True) if tag == x for g in grams(t)) for x in names}
    total = {x: sum(c.values()) + 0.05 * 65536 for x, c in counts.items()}
    likely, alone = [], []
    for text, _, _ in rows:
        g = grams(text)
        scale = min(len(g), 300) / 3 / len(g) if g else 0
        own = {x: scale * sum(math.log((counts[x][b] + 0.05) / total[x]) for b in g) for x in names} | {"und": -scale * len(g) * math.log(65536) + math.log(0.001)}
        likely.append(own)
        alone.append(max(own, key=own.get) if g else "und")
    hosts = [host(a) for _, _, a in rows]
    domain = {h: ".".join(h.split(".")[-2:]) for h in hosts}
    seen = Counter(zip(hosts, alone, strict=True))
    whole = {x: sum(n for (_, y), n in seen.items() if y == x) for x in names}
    out = []
    for (text, _, address), own, tag, h, by_text in zip(rows, likely, tags, hosts, alone, strict=True):
        if not grams(text):
            out.append(("und", 0.0, "und"))
            continue
        post = {"und": own["und"]}
        of_domain = {x: sum(n for (k, y), n in seen.items() if domain[k] == domain[h] and y == x) for x in names}
        for x in names:
            top = (whole[x] + 1) / (sum(whole.values()) + len(names))
            middle = (of_domain[x] + 20 * top) / (sum(of_domain.values()) + 20)
            prior = (seen[h, x] + 20 * middle) / (sum(seen[h, y] for y in names) + 20)
            told = [(p if e == x else (1 - p) / (len(names) - 1)) for e, p in ((tag, 0.85), (hint(address), 0.7)) if e in names]
            post[x] = own[x] + math.log(prior) + sum(map(math.log, told))
        best = max(post, key=post.get)
        out.append((best, 1 / sum(math.exp(v - post[best]) for v in post.values()), by_text))
    return out


def test_posteriors_against_plain_counting(spark):
    rng = random.Random(11)
    places = ["https://a.example.de/x", "http://b.example.de/fr/1", "src7", None, "", "http://news.co.uk/", "http://m.site.fr/", "http://site.fr/en"]
    rows = []
    for _ in range(300):
        mixed = [rng.choice(WORDS[x]) for x in rng.choices(["en", "fr", "de"], weights=rng.choice([(1, 1, 1), (9, 1, 1), (1, 9, 1), (1, 1, 9)]), k=rng.randrange(0, 6))]
        rows.append((" ".join(mixed), rng.choice(["en", "FR", "de-AT", None, "it"]) if rng.random() < 0.95 else "pl", rng.choice(places)))
    rows += [("ωω ψψ " * 30, None, None), (None, "en", "src7"), ("12 34", "de", None)]
    assert sum(d == "pl" for _, d, _ in rows) >= 5
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    got = [(r["language"], r["confidence"], r["text_language"]) for r in identify_languages(df).orderBy("doc_id").collect()]
    want = brute_posteriors(rows)
    assert len({x for x, _, _ in want}) >= 4
    for g, w, row in zip(got, want, rows, strict=True):
        assert abs(g[1] - w[1]) < 1e-4 and (g[0] == w[0] or w[1] < 0.51) and g[2] == w[2], (row, g, w)


def test_held_out_accuracy(spark):
    rng = random.Random(6)
    train = spark.createDataFrame([(i, speech(rng, x, 30), x) for i, x in enumerate(["en", "fr", "de"] * 40)], "doc_id long, text string, lang string")
    model = TextModel.fit(train, F.col("text"), F.col("lang"), F.xxhash64("doc_id"), 60)
    assert model.languages == ["de", "en", "fr"]
    held_out = [(x, speech(rng, x, 12)) for x in ["en", "fr", "de"] * 50]
    right = sum(model.languages[int(np.argmax(model.scores(t)[:3]))] == x for x, t in held_out)
    assert right >= 0.97 * len(held_out)
    other = model.scores("ωω ψψ χχ " * 20)
    assert int(np.argmax(other[:4])) == 3
    assert len(trigrams("12 !")) == 0


def test_rare_and_many_languages_are_classes(spark):
    rng = random.Random(7)
    rare = lambda: " ".join(rng.choice("czy jest nie się oraz który przez tylko może".split()) for _ in range(30))
    rows = [(i, speech(rng, "en", 30), "en", "h") for i in range(2000)] + [(5000 + i, rare(), "pl", "h") for i in range(6)]
    rows += [(6000 + i, " ".join(f"{x}{rng.choice('aeiou')}{x}" for _ in range(20)), x, "h") for i, x in enumerate([a + b for a in "bcdfghjk" for b in "qvwxzlmnt"] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r["doc_id"]: r for r in identify_languages(df, sample_rows=50).collect()}
    wrong = [(i, x, got[i]["language"]) for i, _, x, _ in rows if got[i]["language"] != x or not got[i]["accepted"]]
    assert len(got) == len(rows) and not [w for w in wrong if w[1] in ("en", "pl")]
    assert len(wrong) <= 0.01 * len(rows)


def test_slices_bound_the_text_of_a_batch():
    import pyarrow as pa

    from chunkyard.llm.common import slices

    texts = ["a" * 10, None, "b" * 1000, "", "c" * 400, "d" * 300, "e" * 300] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["i", "t"])
    for column in (batch, batch.slice(2, 15)):
        parts = list(slices(iter([column]), 1, 700))
        assert [x for p in parts for x in p.column(1).to_pylist()] == column.column(1).to_pylist()
        assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column(1).to_pylist()) <= 700 for p in parts)
    assert len(list(slices(iter([batch]), 1, 1 << 20))) == 1
    assert list(slices(iter([batch.slice(0, 0)]), 1)) == []
