"""Main text of web pages by scoring the document tree.

Paragraphs pass points for their length and commas to the elements that contain them, full to the parent and less to
those above; an element's points are discounted by the share of its text that lies in links. The best container and
those of its siblings that look like it are kept, an article or main element as a whole; menus, forms, adverts and the
like are taken out of the tree before.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chunkyard.llm.common import slices, texts_of

# Element names by role, from the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset("nav header footer aside script style noscript template iframe object embed svg canvas button select option textarea input head title menu dialog map audio video".split())
PARAGRAPHS = frozenset("p pre blockquote td th li dd dt h1 h2 h3 h4 h5 h6 figcaption caption".split())
HOLDERS = frozenset(("article", "main"))
#: Start tags that end an open element of the named kinds.
ENDS_OPEN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that such an end doesn't reach across.
FENCES = frozenset("ul ol dl table body html article section div main aside blockquote".split())

HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id or role that name parts of a page. The first are never part of an article; the others
# may be, so within article and main they say nothing.
_STRONG = (
    r"(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|disqus|respond|replies|comments?|commentlist|cookies?|consent|gdpr|sidebar|nav\w*|navigation|menu|toolbar|breadcrumbs?|"
    r"share|sharing|social|subscribe|newsletter|signup|login|pagination|pager|contentinfo|complementary|dialog|popup|modal)"
)
_WEAK = r"(?:banner|community|notice|alert|side|rail|header|masthead|footer|foot|copyright|related|recommend\w*|overlay|widget|search|skip|tags?|print|hidden)"


def _named(word: str) -> str:
    """A whole name of such words, numbered or placed."""
    return rf"{word}(?:[_-]{word})*(?:[_-](?:\d+|left|right|top|bottom|area|box|slot|list|links?|buttons?|bar))?"


#: Names that mark what is not the article: within article and main, and elsewhere, where the site's own parts count too.
UNLIKELY_INSIDE = re.compile(rf"(?:^|\s)(?:{_named(_STRONG)})(?:$|\s)", re.I)
UNLIKELY = re.compile(
    rf"(?:^|\s)(?:{_named(f'(?:{_STRONG}|{_WEAK})')}|"
    r"(?:site|global|main|top|left|right|mobile|primary|secondary)[_-](?:sidebar|nav\w*|menu|toolbar|masthead|footer|banner|ads?|header)|page[_-]footer)(?:$|\s)",
    re.I,
)
#: Names of readers' comments, which may be longer than the article.
COMMENTS = re.compile(r"(?:^|\s)(?:comments?(?:[_-](?:\d+|area|box|list|body|content|section))?|commentlist|disqus|respond|replies)(?:$|\s)", re.I)
LIKELY = re.compile(r"article|body|content|entry|main|post|story|text", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|aria-hidden\s*=\s*[\"']?true", re.I)
ATTRIBUTE = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
#: A comment, declaration or tag. A quote counts after "=" only; what isn't closed ends with the page.
TOKEN = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*>?|/(?:[^a-zA-Z>][^>]*)?>|(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>?)", re.S)

SHORT = 25
MENU_LINKS = 2 / 3


class Tree:
    """Elements with their parents, and blocks of text in page order: (element, text, characters in links).

    Elements that only their names speak against are listed in ``doubted``; those in ``out`` are taken out.
    """

    def __init__(self, page: str, out: frozenset | set = frozenset()) -> None:
        self.doubted, self.out = [], out
        self.tags, self.parents, self.names, self.dropped, self.inside = ["#"], [0], [""], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack, parts, linked, breaks, at, links = [0], [], [], 0, 0, 0
        holder = 0
        tags, parents = self.tags, self.parents

        def end_block() -> None:
            nonlocal breaks
            if parts:
                if text := " ".join("".join(parts).split()):
                    self.blocks.append((holder, text, len(" ".join("".join(linked).split()))))
                parts.clear()
                linked.clear()
            breaks = 0

        def add(text: str) -> None:
            nonlocal breaks, holder
            if not text or self.dropped[stack[-1]]:
                return
            text = entities.unescape(text)
            if not parts:
                if text.isspace():
                    return
                holder = next(x for x in reversed(stack) if tags[x] not in INLINE)
            if breaks and not text.isspace():
                breaks = 0
            parts.append(text)
            if links:
                linked.append(text)

        def close(position: int) -> None:
            nonlocal links
            for x in stack[position:]:
                links -= tags[x] == "a"
            if any(tags[x] not in INLINE for x in stack[position:]):
                end_block()
            del stack[position:]

        while m := TOKEN.search(page, at):  # from where the last token or raw element ended
            add(page[at : m.start()])
            at = m.end()
            if not (name := m[2]):
                continue
            name = name.lower()
            if m[1]:
                if name == "p" and not any(tags[x] == "p" for x in stack):
                    end_block()
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == name:
                        close(i)
                        break
                    if name in INLINE and tags[stack[i]] not in INLINE:
                        break
                continue
            if name == "br":
                breaks += 1
                if breaks > 1:
                    end_block()
                elif parts:
                    parts.append(" ")
                continue
            if name not in INLINE:
                for i in range(len(stack) - 1, 0, -1):
                    if tags[stack[i]] == "p":
                        close(i)
                        break
                    if tags[stack[i]] in FENCES:
                        break
                if name in ENDS_OPEN:
                    for i in range(len(stack) - 1, 0, -1):
                        if tags[stack[i]] in FENCES:
                            break
                        if tags[stack[i]] in ENDS_OPEN[name]:
                            close(i)
                            break
                end_block()
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                at = len(page) if end is None else page.find(">", end.start()) + 1 or len(page)
                continue
            if name in VOID or m[3].endswith("/") and name in ("svg", "path"):
                continue
            tags.append(name)
            parents.append(stack[-1])
            stack.append(node := len(tags) - 1)
            links += name == "a"
            self._judge(node, name, m[3])
        add(page[at:])
        end_block()

    def _judge(self, node: int, name: str, attributes: str) -> None:
        """Whether an element and all in it are taken out."""
        up = self.parents[node]
        names, out, inside = "", False, self.inside[up]
        doubted = name == "form"  # may hold the whole page
        if attributes.strip():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in reversed(list(ATTRIBUTE.finditer(attributes)))}
            names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
            bare = ATTRIBUTE.sub(lambda x: x[0] if x[1].lower() in ("style", "aria-hidden", "hidden") else " ", attributes)
            out = bool(HIDDEN.search(bare))
            unlikely = UNLIKELY_INSIDE if inside else UNLIKELY
            doubted = doubted or name not in ("html", "body") and bool(COMMENTS.search(names) or name not in HEADINGS and name not in HOLDERS and unlikely.search(names))
        if doubted:
            self.doubted.append(node)
            out = out or node in self.out
        if name in DROPPED:
            out = not (name == "header" and inside)
        self.names.append(names)
        self.dropped.append(out or self.dropped[up])
        self.inside.append(inside or name in HOLDERS)

    def above(self, node: int) -> Iterator[int]:
        while node:
            node = self.parents[node]
            yield node


def _worth(text: str) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 if len(text) >= SHORT else 0.25)


def _unwanted(tree: Tree) -> set[int]:
    """The doubted elements that go: those that hold no article or main and at most half of the points of the page's paragraphs.

    Readers' comments, which may be longer than the article, stay only if there is nothing else.
    """
    n = len(tree.tags)
    doubted = set(tree.doubted)
    points, holds = [0.0] * n, [False] * n
    blocks = [x for x in tree.blocks if tree.tags[x[0]] in PARAGRAPHS] or tree.blocks  # an advert's bare text is no paragraph
    for node, text, links in blocks:
        points[node] += _worth(text) * (1 - min(1.0, links / len(text)))
    for i in range(n - 1, 0, -1):  # what an element holds comes after it
        up = tree.parents[i]
        points[up] += points[i]
        holds[up] = holds[up] or holds[i] or tree.tags[i] in HOLDERS and i not in doubted and not tree.dropped[i]
    out = set()
    for i in tree.doubted:
        most = points[0] * (1 - 1e-9) if COMMENTS.search(tree.names[i]) else points[0] / 2
        if not holds[i] and (points[i] <= most or not points[i]):
            out.add(i)
    return out


def main_text(page: str) -> str:
    """The article of a page, one line per block; empty if the page has none."""
    tree = Tree(page)
    if tree.doubted and (out := _unwanted(tree)):
        tree = Tree(page, out)
    if not tree.blocks:
        return ""
    n = len(tree.tags)
    points, length, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, links in tree.blocks:
        worth = _worth(text)
        base = node if tree.tags[node] in PARAGRAPHS else None
        length[node] += len(text)
        linked[node] += links
        if base is None:
            points[node] += worth
        for level, up in enumerate(tree.above(node)):
            points[up] += worth if level == 0 and base is not None else worth / 2 if level <= 1 else worth / (3 * level)
            length[up] += len(text)
            linked[up] += links
    density = [b / a if a else 0.0 for a, b in zip(length, linked, strict=True)]
    scores = [(p + 5 * bool(tree.names[i] and LIKELY.search(tree.names[i])) * (p > 0)) * (1 - density[i]) for i, p in enumerate(points)]
    candidates = [i for i in range(n) if i and points[i] and tree.tags[i] not in PARAGRAPHS and tree.tags[i] not in ("html", "body", "ul", "ol", "dl", "tr", "tbody")]
    best = max(candidates, key=lambda i: (scores[i], -i), default=0)
    if not best:
        best = next((i for i in range(n) if tree.tags[i] == "body"), 0)
    own = [best, *tree.above(best)]
    best = next((x for kind in ("article", "main") for x in reversed(own) if tree.tags[x] == kind), best)  # the outermost
    kept = {best}
    if best and tree.tags[best] not in ("body", "html"):
        least = max(2.0, scores[best] / 5)
        for i in range(1, n):
            if i != best and tree.parents[i] == tree.parents[best] and length[i]:
                if tree.tags[i] in PARAGRAPHS and density[i] < 0.25 or scores[i] >= least and density[i] < 0.25:
                    kept.add(i)
    menus = set()
    if not tree.inside[best]:  # lists of links before the first and after the last paragraph are menus; between them, and in an article, they are text
        menus = {i for i in range(n) if tree.tags[i] in ("ul", "ol", "dl", "div", "table", "section") and i not in kept and density[i] > MENU_LINKS}
    lines, paragraphs = [], []
    for node, text, _ in tree.blocks:
        own = {node, *tree.above(node)}
        if own & kept:
            if not own & menus:
                paragraphs.append(len(lines))
            lines.append(text)
    return "\n".join(lines[paragraphs[0] : paragraphs[-1] + 1]) if paragraphs else ""


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: id, url, text (empty if there is none) and n_chars, its code points.

    Whole pages are read, however long. Null and empty pages have no text; no rows in, no rows out. Of containers with equal
    points the first in the page is the best. Broken markup is read as browsers do: paragraphs end where the next block starts,
    unclosed elements end with what holds them. Null ids and urls are carried; repeated rows get one row each. Other
    columns are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, 16 << 20):
            texts = [main_text(page) for page in texts_of(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"id {kind}, url string, text string, n_chars long").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
