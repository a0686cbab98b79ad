"""Text functions as columns, with the meaning that Unicode-aware regular expressions have elsewhere.

``\\w``, ``\\d`` and ``\\s`` differ between engines; the classes below are spelt out so that all agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chunkyard import config

#: Runs of white space.
WS = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]+"
#: Line ends of all kinds.
LINE_END = r"\r\n|[\n\r\x0B\f\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"
#: Numbers with their separators, or words.
TOKEN = r"\p{Nd}+(?:[.,/]\p{Nd}+)*|[\p{L}\p{N}_]+"
WORD = r"[\p{L}\p{N}_]+"
#: Words that hold more than digits; with them gone, digits stand alone.
MIXED_WORD = r"\p{Nd}*[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_]*"

# The shapes that headings, contents lines and legal references have in Italian building rules.
HEADING = r"(?i)^[ \t]*(?:(?:art\.|articolo)[ \t]*(\p{Nd}+(?:[ \t]*(?:bis|ter|quater))?)(?:[^\p{L}\p{N}_]|$)|(allegato[ \t]+['\"‘’]?[a-z0-9]+))"
CONTENTS_LINE = r"\.{4,}|[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]\p{Nd}{1,3}[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]*$"
HEADING_FAMILIES = {
    "art_n": r"(?im)^\s*art\.\s*\d+",
    "articolo_n": r"(?im)^\s*articolo\s+\d+",
    "n_title": r"(?m)^\s*\d{1,2}(?:\.\d{1,2})*\.?\s+[A-ZÀ-Ü][^\n]{3,80}$",
}
LEGAL_REFERENCE = r"(?i)\b(?:d\.?\s?lgs|d\.?p\.?r|l\.?r|d\.?m|art\.|comma|allegato)\b"
FREQUENT_WORDS = ("della", "delle", "degli", "sono", "comma", "articolo", "presente", "che", "non")
ABBREVIATIONS = "artt?|nn?|co|comma|lett|ecc|cfr|pag|es|par|cap|all|tab|fig|vol|mq|mc|ml|cm|mm|km|m|h|min|max|sig|dott|ing|arch|geom"
DOT = "<DOT>"


def normalize(text: Column) -> Column:
    """Typographic apostrophes made plain, soft hyphens gone, white space single, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.replace(F.replace(text, F.lit("’"), F.lit("'")), F.lit("\u00ad"), F.lit("")), WS, " ")))


def tokenize(text: Column) -> Column:
    """Lower-case words, and numbers whole with their separators, in order."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("’"), F.lit("'"))), F.lit(TOKEN), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-case words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line, an empty text has none."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def line_key(line: Column) -> Column:
    """What a line has in common with its repetitions on other pages: numbers masked, folded, the first characters."""
    folded = F.regexp_replace(F.regexp_replace(line, WS, " "), r"\p{Nd}+", "#")
    return F.substring(F.lower(F.trim(folded)), 1, config.KEY_CHARS)


def stripped(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{WS}|{WS}$", "")


def chunk_id(source: Column, index: Column, text: Column) -> Column:
    """16 hexadecimal digits that depend on source, position and wording."""
    return F.substring(F.sha2(F.concat_ws("|", F.coalesce(source, F.lit("unknown")), index.cast("string"), text), 256), 1, 16)


def is_contents_line(line: Column) -> Column:
    """Dot leaders, or a page number at the end."""
    return line.rlike(CONTENTS_LINE)


def heading_label(line: Column) -> Column:
    """The label of a heading line, null for others and for lines of a table of contents."""
    found = F.coalesce(F.nullif(F.regexp_extract(line, HEADING, 1), F.lit("")), F.nullif(F.regexp_extract(line, HEADING, 2), F.lit("")))
    clean = F.lower(F.trim(F.regexp_replace(found, r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}'\"‘’]+", " ")))
    return F.when(~is_contents_line(line), clean)


def protect_abbreviations(text: Column) -> Column:
    """Dots of dotted acronyms and of abbreviations before white space become a mark, so that they end no sentence."""
    # the text in pieces: acronyms where they stand, and all between; a run of letters can start one at its first letter only
    start, end = r"(?<![\p{L}\p{N}_])", r"[A-Za-z]{1,4}"
    pieces = F.regexp_extract_all(text, F.lit(rf"{start}(?:{end}\.){{2,}}|[A-Za-z]+[^A-Za-z]*|[^A-Za-z]+"), F.lit(0))
    marked = F.array_join(F.transform(pieces, lambda x: F.when(F.regexp_like(x, F.lit(rf"^(?:{end}\.){{2,}}$")), F.replace(x, F.lit("."), F.lit(DOT))).otherwise(x)), "")
    return F.regexp_replace(marked, rf"(?i)(?<![\p{{L}}\p{{N}}_])({ABBREVIATIONS})\.(?=[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}])", f"$1{DOT}")


def restore_abbreviations(text: Column) -> Column:
    return F.replace(text, F.lit(DOT), F.lit("."))


def refused(answer: Column) -> Column:
    """Whether an answer says that nothing was found."""
    return F.contains(normalize(answer), F.lit(config.REFUSAL))


def preview(text: Column, n: int) -> Column:
    """The first characters, with dots where more follow."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def number_count(text: Column) -> Column:
    """Decimal numbers, and whole numbers of up to four digits, that stand as words of their own."""
    alone = F.regexp_replace(text, MIXED_WORD, "x")
    rest = F.regexp_replace(F.regexp_replace(alone, r"\p{Nd}+[.,]\p{Nd}+", "y"), r"\p{Nd}{5,}", "z")
    return F.regexp_count(alone, F.lit(r"\p{Nd}+[.,]\p{Nd}+")) + F.regexp_count(rest, F.lit(r"\p{Nd}+"))


def ascii_words(text: Column) -> Column:
    """Letters and digits beyond ASCII as x: word boundaries then mean the same to every engine."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\x00-\x7F\P{L}]", "x"), r"[^\x00-\x7F\P{N}]", "x")


def legal_reference_count(text: Column) -> Column:
    return F.regexp_count(ascii_words(text), F.lit(LEGAL_REFERENCE))


def heading_count(text: Column, family: str) -> Column:
    """Headings of a family, lines ending with line feeds only."""
    return F.regexp_count(text, F.lit("(?d)" + HEADING_FAMILIES[family]))


def source_prefix(source: Column) -> Column:
    """The file stem up to its first underscore; the stem ends before the last dot that isn't its first character."""
    name = F.regexp_extract(source, r"([^/]*)$", 1)
    return F.substring_index(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), "_", 1)
