"""Licence scans by template markup: templates with optional and replaceable regions, compiled into one token automaton.

A template is wording with ``<<beginOptional>>...<<endOptional>>`` around words that may be missing (they nest) and
``<<var;words=a-b>>`` for a to b words of any kind. Compiled, every word that is neither optional nor replaceable must
appear exactly, in order and without gaps. All templates run together in one pass over a text's words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import slices, texts_of

# The base phrases and their labels.
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Templates by label: ``-text`` is a licence from its grant to the end of its disclaimer, ``-header`` what a file states in its
#: place, ``-notice`` a sentence that refers to it. Longer licences (the full Apache and GNU texts) go into ``scan_licenses`` as a parameter.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1-6>> and
        associated documentation files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without
        restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do
        so, subject to the following conditions: The above copyright notice and this permission notice
        <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial
        portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL <<var;words=2-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-notice": "<<beginOptional>>is <<endOptional>>(released|licensed|distributed|available) under the <<beginOptional>>terms of the <<endOptional>>MIT License",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
        SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE
        FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF
        USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR
        IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: <<var;words=0-1>> Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. <<var;words=0-1>> Redistributions in
        binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution.
        <<beginOptional>><<var;words=0-1>> Neither the name of <<var;words=1-12>> nor the names of <<var;words=0-1>>
        contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. <<endOptional>>THIS SOFTWARE IS PROVIDED BY <<var;words=1-12>> "AS IS" AND ANY EXPRESS OR
        IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words=1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT,
        INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
        IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "apache-header": """Licensed under the Apache License, Version <<var;words=1-2>> (the "License"); you may not use this
        file except in compliance with the License. You may obtain a copy of the License at <<var;words=1-12>> Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
    "apache-notice": "(released|licensed|distributed|available) under the <<beginOptional>>terms of the <<endOptional>>Apache License<<beginOptional>>, Version <<var;words=1-2>><<endOptional>>",
    "gpl-notice": """licensed under the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General
        Public License<<beginOptional>>, version <<var;words=1-2>><<endOptional>>""",
    "gpl-header": """This <<var;words=1-4>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or
        modify it under the terms of the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero <<endOptional>>General
        Public License as published by the Free Software Foundation<<beginOptional>>,<<endOptional>> either version
        <<var;words=1-2>> of the License, or (at your option) any later version. This <<var;words=1-4>> is distributed in
        the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY
        or FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<beginOptional>>Lesser <<endOptional>><<beginOptional>>Affero
        <<endOptional>>General Public License for more details.""",
    "cc-by-nc-notice": "(licensed|available|released) under <<beginOptional>>the <<endOptional>>CC BY-NC<<beginOptional>> <<var;words=1-2>><<endOptional>>",
}

#: Everything but digits, letters and what lies beyond ASCII separates words; A-Z become a-z.
_FOLD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var;words=(\d+)-(\d+))>>|\(([\w|]*\|[\w|]*)\)")


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after lower-casing A-Z, in UTF-8."""
    return text.encode().translate(_FOLD).split()


class TokenAutomaton:
    """A nondeterministic automaton over words for a set of templates."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.labels = list(templates)
        self.words: list[list[tuple[frozenset | None, int]]] = []  # per state: (accepted words, or None for any; next state)
        self.skips: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.mandatory: list[int] = []
        begins = [self._compile(i, t) for i, t in enumerate(templates.values())]
        closures = [self._closure(s) for s in range(len(self.words))]
        #: What a state reads, free moves included, and the templates that it ends.
        self.edges = [[edge for s in closures[x] for edge in self.words[s]] for x in range(len(self.words))]
        self.ends = [tuple(self.accepts[s] for s in closures[x] if s in self.accepts) for x in range(len(self.words))]
        self.first: dict[bytes, list[int]] = {}
        for b in begins:
            for s in closures[b]:
                if s in self.accepts:
                    raise ValueError("a template accepts the empty text")
                for accepted, n in self.words[s]:
                    if accepted is None:
                        raise ValueError("a template starts with a replaceable region")
                    for w in accepted:
                        self.first.setdefault(w, []).append(n)
        #: Words that can follow a first word; None where any can, or nothing need.
        self.second: dict[bytes, frozenset | None] = {}
        for w, states in self.first.items():
            reads = [a for s in states for a, _ in self.edges[s]]
            open_end = any(self.ends[s] for s in states) or None in reads
            self.second[w] = None if open_end else frozenset().union(*reads)

    def _state(self) -> int:
        self.words.append([])
        self.skips.append([])
        return len(self.words) - 1

    def _compile(self, index: int, template: str) -> int:
        begin = now = self._state()
        opened: list[int] = []
        needed = at = 0

        def literal(text: str) -> None:
            nonlocal now, needed
            for w in words_of(text):
                self.words[now].append((frozenset((w,)), n := self._state()))
                now = n
                needed += not opened

        for m in _MARKUP.finditer(template):
            literal(template[at : m.start()])
            at = m.end()
            if m[4]:
                self.words[now].append((frozenset(w.encode().lower() for w in m[4].split("|")), n := self._state()))
                now = n
                needed += not opened
            elif m[1] == "beginOptional":
                opened.append(now)
            elif m[1] == "endOptional":
                n = self._state()
                self.skips[now].append(n)
                self.skips[opened.pop()].append(n)
                now = n
            else:
                least, most = int(m[2]), int(m[3])
                end = self._state()
                for k in range(most + 1):
                    if k >= least:
                        self.skips[now].append(end)
                    if k < most:
                        self.words[now].append((None, n := self._state()))
                        now = n
                now = end
        literal(template[at:])
        if opened:
            raise ValueError("an optional region isn't closed")
        self.accepts[now] = index
        self.mandatory.append(needed)
        return begin

    def _closure(self, state: int) -> tuple[int, ...]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return tuple(sorted(seen))

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(template, first word) of every place where a template's mandatory wording stands, in one pass.

        Where paths of one template that began at different words meet, the earliest start stands for both; templates
        without replaceable or optional regions have no such paths, so all their places are found.
        """
        first, second, edges, ends, n = self.first, self.second, self.edges, self.ends, len(words)
        found: set[tuple[int, int]] = set()
        done = 0
        for begin in [i for i, w in enumerate(words) if w in first]:
            if begin < done or (follow := second[words[begin]]) is not None and (begin + 1 == n or words[begin + 1] not in follow):
                continue
            active: dict[int, int] = {}
            at = begin
            while at < n:
                w, new = words[at], {}
                for state, start in active.items():
                    for accepted, s in edges[state]:
                        if (accepted is None or w in accepted) and new.get(s, n) > start:
                            new[s] = start
                for s in first.get(w, ()):
                    new.setdefault(s, at)
                at += 1
                for s, start in new.items():
                    for t in ends[s]:
                        found.add((t, start))
                active = new
                if not new:
                    break
            done = at
        return sorted(found)

    def accepts_text(self, text: str, label: str) -> bool:
        """Whether a whole text is the template ``label``."""
        words, goal = words_of(text), self.labels.index(label)
        active = set(self.first.get(words[0], ())) if words else set()
        for w in words[1:]:
            active = {s for x in active for a, s in self.edges[x] if a is None or w in a}
        return any(goal in self.ends[s] for s in active)


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``df``, however long its text: id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_matches.

    ``n_base`` counts the places of the phrases in :data:`BASE`, ``first_word`` and ``last_word`` are their smallest and
    largest start (null without any). ``labels`` adds the labels of ``templates`` (default :data:`TEMPLATES`) that match
    anywhere. ``score`` is m / (m + 2) for the matched template with most mandatory words m, 0 without a match. Null and
    empty texts have no words. Null ids are carried; repeated rows get one row each. Other columns are not read.
    """
    wanted = {f"base {k}": v for k, v in BASE.items()} | (TEMPLATES if templates is None else templates)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = TokenAutomaton(wanted)
        base, names = len(BASE), list(BASE) + automaton.labels[len(BASE) :]
        weights = [m / (m + 2) for m in automaton.mandatory]
        for batch in slices(batches, 1):
            rows = []
            for text in texts_of(batch.column(1)):
                words = words_of(text)
                found = automaton.matches(words)
                starts = [s for t, s in found if t < base]
                label = lambda which: ",".join(sorted({names[t] for t, _ in found if which(t)}))  # noqa: E731, B023
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), label(lambda t: t < base), label(lambda t: True), max((weights[t] for t, _ in found), default=0.0), len(found)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_matches"])

    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_matches long"
    )
    return out.withColumnRenamed("id", id_col)
