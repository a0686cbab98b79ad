"""Repair of UTF-8 text that was decoded as Windows-1252, and of characters that only look like plain ones."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Windows-1252 with its five unassigned bytes read as the control characters of their number.
_BYTES = {bytes([b]).decode("cp1252", "replace") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b): b for b in range(0x80, 0x100)} | {chr(b): b for b in range(0x80, 0xA0)}
_HIGH = "".join(map(re.escape, _BYTES))
#: A lead byte and its continuation bytes, as they look when misread.
_LEAD = {n: "".join(re.escape(c) for c, b in _BYTES.items() if low <= b <= high) for n, low, high in ((1, 0xC2, 0xDF), (2, 0xE0, 0xEF), (3, 0xF0, 0xF4))}
_FOLLOW = "".join(re.escape(c) for c, b in _BYTES.items() if 0x80 <= b <= 0xBF)
_MISREAD = re.compile("|".join(f"[{lead}](?:[{_FOLLOW}]){{{n}}}" for n, lead in _LEAD.items()))

#: The second byte of a misread à, turned from a no-break space into a plain one, with the space that followed it.
_A_GRAVE = re.compile(r"(?<=\w)Ã (?=\s)")

# What is spelt out in plain characters, and what is left out.
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ſt", "ﬆ": "st", "Ĳ": "IJ", "ĳ": "ij"}
_QUOTES = {**dict.fromkeys("\u02bc\u2018\u2019\u201a\u201b", "'"), **dict.fromkeys("\u201c\u201d\u201e\u201f", '"')}
_CONTROLS = dict.fromkeys([*range(0x00, 0x09), 0x0B, *range(0x0E, 0x20), 0x7F, *range(0x206A, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFD)])
_PLAIN = {**str.maketrans(_LIGATURES), **str.maketrans(_QUOTES), **_CONTROLS, 0x3000: " "}
_LINE_END = re.compile("\r\n|[\r\x85\u2028\u2029]")
_TERMINAL = re.compile(r"\x1b\[[\d;]*[A-Za-z]")
_WIDE = re.compile("[\uff01-\uffef]+")
_REFERENCE = re.compile(r"&#?[0-9A-Za-z]{1,24};")
#: Texts without any of these are as they should be.
_SUSPECT = r"[^\x09\x0A\x0C\x20-\x7E]|&#?[0-9A-Za-z]{1,24};"


def _read_again(match: re.Match) -> str:
    try:
        return bytes(_BYTES[c] for c in match[0]).decode("utf-8")
    except UnicodeDecodeError:
        return match[0]


def fix_text(text: str) -> str:
    """Misread characters read again until nothing changes, and what typesetting or terminals left made plain.

    Character references are resolved in texts without "<"; terminal colours and control characters go; ligatures are spelt
    out; wide characters, quotation marks and line ends get their usual form; the result is composed (NFC).
    """
    if "<" not in text:
        text = _REFERENCE.sub(lambda m: html.unescape(m[0]), text)
    text = _TERMINAL.sub("", text)
    before = None
    while before != text:
        before, text = text, _A_GRAVE.sub("à", _MISREAD.sub(_read_again, text))
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
    return unicodedata.normalize("NFC", _LINE_END.sub("\n", text).translate(_PLAIN))


def fixed(text: Column) -> Column:
    """:func:`fix_text` of a column. Texts of plain ASCII characters alone skip Python."""

    @F.pandas_udf("string")
    def repaired(texts: pd.Series) -> pd.Series:
        return texts.map(fix_text, na_action="ignore")

    return F.when(text.rlike(_SUSPECT), repaired(text)).otherwise(text)
