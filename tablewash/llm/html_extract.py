"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one per block element. A line weighs the length
of its text outside links; lines of page furniture (menus, headers, footers,
sidebars, notices, adverts, forms, reader comments) and, where the page has an
``article`` or ``main`` element, lines outside it, weigh nothing. The weights
are summed over sliding windows of ``WINDOW`` lines. A surge point is a line
whose window sum rises over a threshold, a dive point the next line whose
window sum is nothing; the text between them is kept. Inside an article a line
weighs its whole text, links included, and the threshold is zero, so nothing of
it is lost. There a class or id alone drops no heading, paragraph or block of prose
(``PROSE`` characters), reader comments excepted, and a block marked as a header keeps its
headings. A form around most of the page's prose is no furniture. An article of linked lines only is kept whole, and the lines outside it
are judged as on a page without one.

Character references are decoded after the markup is gone, white space inside a
block becomes one blank, and blocks are joined by one blank in page order.
Null and empty pages, and pages without text, give an empty text. Pages of any
length are read whole; unclosed elements end with the page.
"""

from __future__ import annotations

import html as html_lib
import re

from pyspark.sql import DataFrame

from tablewash.llm.common import map_texts

WINDOW = 3
SURGE = 86  # characters in a window; a quarter of the largest window if that is less

# A quoted value of over 4,000 characters ends where an attribute or the tag can end. After a
# quote that never closes so, and in a tag that never ends, the next ">" ends the tag.
_QUOTED = "|".join(f"{q}[^{q}]{{0,4000}}{q}|{q}[^{q}]*+{q}(?=[\\s/>]|[a-zA-Z_:@][\\w:.-]{{0,100}}\\s*=)" for q in "\"'")
_ATTRS = f"(?:[^>\"']|{_QUOTED})*+(?:[\"'][^>]*+)?"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|title|textarea|noscript|template|iframe|xmp|noembed)\b{_ATTRS}>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    rf"|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>",
    re.S | re.I)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr "
                    "q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FURNITURE = frozenset("nav header footer aside form head menu dialog button select option svg canvas object "
                       "audio video map datalist fieldset".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog "
                             "menu menubar toolbar".split())
_FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie "
    "cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup sidebar aside "
    "menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer comment comments "
    "commentlist disqus respond reply replies share sharing social related recommended popup modal overlay widget "
    "widgets toolbar pager pagination login".split())
# Inside an article these words on a class or id mark a heading block like <header>; blocks marked
# by another word stay there if they hold this much text in paragraphs, reader comments excepted.
_HEADER_WORDS = frozenset("header masthead topbar".split())
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
PROSE = 300
_MAIN = frozenset(("article", "main"))
_PAGE = frozenset(("html", "body", "article", "main"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


def _furniture(name: str, attrs: str) -> set[str] | bool:
    """Whether an element is furniture by its name, role or state; the words of its
    class and id if it is furniture only by these."""
    if name in _FURNITURE:
        return True
    if not attrs or attrs.isspace():
        return False
    words: set[str] = set()
    for m in _ATTR.finditer(attrs):
        key = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "role" and value in _FURNITURE_ROLES:
            return True
        if key in ("class", "id") and name not in _PAGE:
            words |= _FURNITURE_WORDS.intersection(re.split(r"[^a-z0-9]+", value))
    return words or False


class _Page:
    """Lines of one page: text, weight and whether inside an article."""

    def __init__(self, html: str):
        self.lines: list[tuple[str, int, bool]] = []
        self.parts: list[str] = []
        self.plain = 0  # characters outside links
        self.main = self.link = 0
        self._read(html)

    def _end_line(self) -> None:
        if self.parts:
            text = " ".join(html_lib.unescape("".join(self.parts)).split())
            if text:
                self.lines.append((text, len(text) if self.plain else 0, self.main > 0))
            self.parts = []
        self.plain = 0

    def _gap(self) -> None:
        """Furniture stands between lines as an empty window."""
        self._end_line()
        self.lines.extend([("", 0, self.main > 0)] * WINDOW)

    def _text(self, s: str) -> None:
        if s:
            self.parts.append(s)
            if not self.link and not s.isspace():
                self.plain += len(s)

    def _read(self, html: str) -> None:
        tokens, at = [], 0  # (text before, closing, name, attributes)
        last_close: dict[str, int] = {}
        for m in _TOKEN.finditer(html):
            name = (m[3] or m[6] or "").lower()
            closing = bool(m[2] or m[5])
            if closing:
                last_close[name] = len(tokens)
            tokens.append((html[at:m.start()], closing, name, m[4] or m[7] or ""))
            at = m.end()
        self.total = sum(len(t[0].strip()) for t in tokens)
        i, n = 0, len(tokens)
        while i < n:
            before, closing, name, attrs = tokens[i]
            self._text(before)
            i += 1
            if not name:  # comment, declaration, or raw text element
                continue
            if name == "a":
                self.link = 0 if closing else 1
                continue
            if name in _INLINE and (closing or not attrs):
                continue
            if name in _VOID:
                if name in ("br", "hr"):
                    self.parts.append(" ")
                continue
            if closing:
                if name not in _INLINE:
                    self._end_line()
                    self.link = 0
                    if name in _MAIN:
                        self.main = max(0, self.main - 1)
                continue
            kind = _furniture(name, attrs)
            if kind and not attrs.rstrip().endswith("/") and not self._kept(tokens, i, name, last_close.get(name, -1), kind):
                titled = self.main and (name == "header" or kind is not True and not _HEADER_WORDS.isdisjoint(kind))
                i = self._skip(tokens, i, name, last_close.get(name, -1), titled)
                continue
            if name in _INLINE:
                continue
            self._end_line()
            self.link = 0
            if name in _MAIN:
                self.main += 1
        self._text(html[at:])
        self._end_line()

    def _kept(self, tokens, i: int, name: str, last: int, kind: set[str] | bool) -> bool:
        """Whether an element that looks like furniture holds the text that is looked for:
        a form around most of the page's prose; inside an article, a heading or paragraph
        with a furniture word, or a block with such a word (reader comments excepted) that
        holds prose."""
        if kind is True and name != "form":
            return False
        if kind is not True:
            if not self.main or not _COMMENT_WORDS.isdisjoint(kind):
                return False
            if name == "p" or name in _HEADINGS:
                return True
        depth, j, inside, prose = 1, i, 0, 0
        while j <= last and depth:
            before, closing, other, _ = tokens[j]
            prose += len(before.strip()) if inside else 0
            if other == name:
                depth += -1 if closing else 1
            elif other == "p" or other in _MAIN:
                inside = 0 if closing else 1
            elif inside and other == "a":
                inside = 1 if closing else 0  # a link is no prose
            j += 1
        if depth:
            return False
        if name == "form" and kind is True:
            return not self.main and prose >= PROSE and prose * 2 > self.total
        return prose >= PROSE

    def _skip(self, tokens, i: int, name: str, last: int, titled: bool) -> int:
        """The token after the furniture that began before token i; headings in a
        ``titled`` one stay. One that is never closed ends at the next block."""
        if name not in _INLINE:
            self._gap()
        depth, j, heading = 1, i, False
        while j <= last:
            before, closing, other, _ = tokens[j]
            if heading:
                self._text(before)
            if other == name:
                depth += -1 if closing else 1
                if not depth:
                    self._end_line()
                    return j + 1
            elif other in _HEADINGS and titled:  # an article's title
                self._end_line()
                heading = not closing
            j += 1
        self.parts, self.plain = [], 0
        while i < len(tokens) and (not tokens[i][2] or tokens[i][2] in _INLINE or tokens[i][2] in _VOID):
            i += 1
        if i < len(tokens):
            tokens[i] = ("",) + tokens[i][1:]
        return i


def extract(html: str | None) -> str:
    """Main text of one page."""
    if not html:
        return ""
    lines = _Page(html).lines
    article = any(inside and weight for _, weight, inside in lines)
    weights = [w if not article else len(text) if inside else 0 for text, w, inside in lines]
    n = len(weights)
    sums = [sum(weights[i:i + WINDOW]) for i in range(n)]
    threshold = 0 if article else min(SURGE, max(sums, default=0) / 4)
    out, i = [], 0
    while i < n:
        if sums[i] <= threshold or not (weights[i] or lines[i][0]):
            if lines[i][0] and lines[i][2]:
                out.append(lines[i][0])
            i += 1
            continue
        while i < n and sums[i]:  # from the surge to the dive
            if lines[i][0] and (lines[i][2] or not article):
                out.append(lines[i][0])
            i += 1
    return " ".join(out)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars`` of every page."""
    def make():
        def work(pages_):
            text = [extract(h) for h in pages_]
            return [text, [len(t) for t in text]]

        return work

    return map_texts(pages, [id_col, url_col], html_col, make, {"text": "string", "n_chars": "long"})
