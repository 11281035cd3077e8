"""Main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block-level tags (inline tags such as ``b`` or
``a`` don't count: they are often left open). Over the page, the text length and the punctuation of all blocks of a path
are summed and divided by the number of its blocks; both ratios are smoothed over neighbouring paths in page order by a
Gaussian, fused (geometric mean, less the share of text in links), and paths at or above a share of the best one are
content. Every block of a content path is content, however short it is itself and wherever it is. The main container is the
smallest element that holds nearly all content, or the ``article``/``main`` element if one holds most of it; short blocks
inside it belong to the text, too, unless their path's text is mostly links, as do headings and blocks that aren't mostly links between blocks of content, and the
heading before the first one. Menus, forms, notices and the like don't wherever they are: by tag, or by a role, class or id
that consists of such words, unless the element holds most of the page's content (advertisements, comments and notices of
cookies never belong, in inline elements either).

A page is read once from left to right, in time and memory that follow its length, however broken or deeply nested it is.

Defined results: a null or empty page, and one with nothing but markup or boilerplate, has empty text; broken markup is
read as browsers do as far as implied end tags go; repeated rows have repeated results; other columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from pavilion.llm.words import slices

#: HTML's elements by how they take part in paths.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "object", "canvas", "audio", "video", "select"}
BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "head"}
#: Words of class, id and role that mark what isn't the article.
MARKS = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "copyright", "dialog", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "pager", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}
#: Words that a class or id may have beside marks and still be one ("sidebar-left", but not "has-sidebar").
BOXES = {"area", "bar", "block", "bottom", "box", "container", "content", "inner", "left", "link", "links", "list", "main", "outer", "post", "posts", "right", "section", "site", "top", "wrap", "wrapper"}
#: Marks of what isn't the article even if it is most of the page, and those that an article's own header may have.
NEVER = {"ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "replies", "reply", "respond"}
HEADERS = {"banner", "header", "masthead"}
#: A new element of these closes an open paragraph; list items, cells and the like close one another.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "main", "div", "blockquote", "nav", "aside", "footer", "header", "form"}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/=>][^\s/=>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_PUNCTUATION = re.compile(r"""[.,;:!?。，；：！？、…]""")
#: Paths at or above this share of the best score are content; the smoothing kernel's width; share of content that the article holds.
THRESHOLD, WIDTH, HOLDS = 0.2, 0.7, 0.9


class _Element:
    """An element, with what follows from its ancestors: a path number, whether it is left out, in an article or a header."""

    __slots__ = ("name", "parent", "number", "depth", "path", "boilerplate", "marks", "article", "header", "content", "headed", "gone", "inside")

    def __init__(self, name: str, parent: _Element | None, number: int, path: int):
        self.name, self.parent, self.number, self.path, self.depth = name, parent, number, path, parent.depth + 1 if parent else 0
        self.article = bool(parent) and (parent.article or name in ("article", "main"))
        self.header = bool(parent) and (parent.header or name == "header")
        self.boilerplate, self.marks, self.content, self.headed, self.gone, self.inside = bool(parent) and parent.boilerplate, frozenset(), 0, False, False, False


class _Tags:
    """The tags of a page, read from left to right; whatever the page, each of its characters is looked at a few times."""

    def __init__(self, page: str):
        self.page, self.unclosed = page, set()

    def next(self, at: int) -> tuple[int, int, str, str, str]:
        """From ``at``: where markup begins and ends, and a tag's slash, name and attributes (no name: a comment and the like)."""
        page, n = self.page, len(self.page)
        while True:
            at = page.find("<", at)
            if at < 0 or at + 1 >= n:
                return n, n, "", "", ""
            c = page[at + 1]
            if c in "!?":
                close = "-->" if page.startswith("<!--", at) else ">"
                end = page.find(close, at + 2)
                return at, end + len(close) if end >= 0 else n, "", "", ""
            slash = "/" if c == "/" else ""
            if m := _NAME.match(page, at + 1 + len(slash)):
                end = self._end(m.end())
                return at, min(n, end + 1), slash, m[0].lower(), page[m.end() : end]
            at += 1

    def _end(self, at: int) -> int:
        """The place of the tag's closing bracket outside quotes; the page's end if there is none."""
        while m := _STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return m.start()
            if m[0] not in self.unclosed:  # a quote that is never closed is an ordinary character
                close = self.page.find(m[0], at)
                if close < 0:
                    self.unclosed.add(m[0])
                at = close + 1 if close >= 0 else at
        return len(self.page)

    def after(self, name: str, at: int) -> int:
        """Where the closing tag of an element begins; -1 if there is none."""
        if name in self.unclosed:
            return -1
        m = re.compile(rf"</{re.escape(name)}[\s>/]", re.I).search(self.page, at)
        if not m:
            self.unclosed.add(name)
        return m.start() if m else -1


def _attributes(text: str) -> dict[str, str]:
    """Names and values, in lower case, of the attributes that matter here; the first of each name counts."""
    out: dict[str, str] = {}
    if text and text != "/":
        for m in _ATTRIBUTE.finditer(text):
            if (key := m[1].lower()) in ("class", "id", "role", "hidden", "aria-hidden"):
                out.setdefault(key, (m[2] or "").strip("\"'").lower())
    return out


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true"


def _marks(attributes: dict[str, str], article: bool) -> frozenset[str]:
    """The marks of an element's classes, id and role, of those that consist of marks and BOXES only."""
    out: set[str] = set()
    for key in ("class", "id", "role"):
        for token in attributes.get(key, "").split():
            words = {w for w in re.split(r"[^a-z]+", token) if w}
            if words <= MARKS | BOXES:
                out |= words & MARKS
    return frozenset(out - HEADERS if article else out)


def blocks(page: str) -> tuple[list[tuple[str, _Element, int]], list[_Element]]:
    """Text, innermost block element and characters in links of each block outside boilerplate, in page order; and all elements, parents first."""
    tags, paths = _Tags(page), {}
    root = _Element("", None, 0, 0)
    stack, elements, out = [root], [root], []
    opened: list[dict[str, int]] = [{}]  # of each scope that is open: how many elements of each name are open right in it
    scopes: dict[str, int] = {}  # how many of each kind are open
    text: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)
    skipped, depth, in_math = "", 0, False  # an inline element that is left out, how often its name is open, and formulas

    def flush() -> None:
        nonlocal linked, skipped
        if text:
            joined = " ".join("".join(text).split())
            if joined and not stack[-1].boilerplate:
                out.append((joined, stack[-1], linked))
            text.clear()
        linked, skipped = 0, ""

    def close(k: int) -> None:
        while len(stack) > k:
            name = stack.pop().name
            if name in _SCOPE:
                opened.pop()
                scopes[name] -= 1
            else:
                opened[-1][name] -= 1

    while at < n:
        begin, end, slash, name, rest = tags.next(at)
        if begin > at and not stack[-1].boilerplate and not skipped:
            piece = page[at:begin]
            piece = html.unescape(piece) if "&" in piece else piece
            text.append(piece)
            linked += len(piece) if in_link else 0
        at = end
        if not name:
            continue
        if name in RAW:
            if not slash and not rest.endswith("/"):
                to = tags.after(name, at)
                at = to if to >= 0 else n if name in ("script", "style") else at
            continue
        if name == "math" or in_math:
            in_math = not slash if name == "math" else True
            continue
        if name in INLINE or name in VOID:
            if name == skipped:
                depth += -1 if slash else 1
                skipped = skipped if depth else ""
            elif name in INLINE and not slash and not skipped and rest and (_hidden(own := _attributes(rest)) or _marks(own, False) & NEVER):
                skipped, depth = name, 1
            if name == "a":
                in_link = 0 if slash else 1
            elif name in ("br", "hr"):
                text.append(" ")
            continue
        flush()
        in_link = 0
        if slash:
            if (scopes if name in _SCOPE else opened[-1]).get(name):
                k = len(stack) - 1
                while stack[k].name != name:
                    k -= 1
                close(k)
            continue
        closes = _CLOSES.get(name, {"p"})
        if any(opened[-1].get(c) for c in closes):
            k = len(stack) - 1
            while stack[k].name not in closes:
                k -= 1
            close(k)
        if rest.endswith("/"):
            continue
        parent = stack[-1]
        element = _Element(name, parent, len(elements), paths.setdefault((parent.path, name), len(paths) + 1))
        own = _attributes(rest)
        element.boilerplate |= name in BOILERPLATE or name == "header" and not parent.article or _hidden(own)
        if own and name not in ("html", "body", "main"):
            element.marks = _marks(own, parent.article)
        stack.append(element)
        elements.append(element)
        if name in _SCOPE:
            opened.append({})
            scopes[name] = scopes.get(name, 0) + 1
        else:
            opened[-1][name] = opened[-1].get(name, 0) + 1
    flush()
    return out, elements


def _scores(found: list[tuple[str, _Element, int]]) -> tuple[dict[int, float], set[int]]:
    """The fused score of each path, and the paths whose text is mostly links."""
    sums: dict[int, list[float]] = {}
    for text, element, linked in found:
        s = sums.setdefault(element.path, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCTUATION.findall(text))
        s[2] += min(linked, len(text))
        s[3] += 1
    paths = [*sums]
    ratios = [(s[0] / s[3], s[1] / s[3]) for s in sums.values()]
    kernel = [math.exp(-(d * d) / (2 * WIDTH * WIDTH)) for d in range(3)]
    out = {}
    for i, path in enumerate(paths):
        near = [(kernel[abs(i - j)], ratios[j]) for j in range(max(0, i - 2), min(len(paths), i + 3))]
        weight = sum(w for w, _ in near)
        length, marks = (sum(w * r[k] for w, r in near) / weight for k in (0, 1))
        chars, _, linked, _ = sums[path]
        own = min(1.0, ratios[i][0] / max(length, 1e-9))  # smoothing lends nothing to a path of far shorter texts
        out[path] = math.sqrt(length * (marks + 0.1)) * own * (1 - linked / chars if chars else 0)
    return out, {path for path, s in sums.items() if 2 * s[2] >= s[0]}


def _weighed(found: list[tuple[str, _Element, int]], elements: list[_Element], sizes: list[int]) -> None:
    """Sets each element's content, the sizes of all blocks in it, and whether a heading is in it."""
    for element in elements:
        element.content, element.headed = 0, False
    for (_, element, _), size in zip(found, sizes, strict=True):
        element.content += size
        element.headed |= _heading(element)
    for element in reversed(elements[1:]):
        element.parent.content += element.content
        element.parent.headed |= element.headed


def _unmarked(found: list[tuple[str, _Element, int]], elements: list[_Element]) -> list[tuple[str, _Element, int]]:
    """The blocks outside marked elements. A mark doesn't count on what holds most of the page's content, or a heading of an article's header."""
    if not found or not any(e.marks for e in elements):
        return found
    scores, _ = _scores(found)
    least = THRESHOLD * max(scores.values())
    _weighed(found, elements, [len(text) - min(linked, len(text)) if scores[element.path] >= least else 0 for text, element, linked in found])
    total = elements[0].content
    for e in elements[1:]:
        counts = e.marks and (e.marks & NEVER or not (e.header and e.headed) and 2 * e.content <= total)
        e.gone = e.parent.gone or bool(counts)
    return [block for block in found if not block[1].gone]


def _heading(element: _Element) -> bool:
    return len(element.name) == 2 and element.name[0] == "h" and element.name[1] in "123456"


def main_text(page: str | None) -> str:
    found, elements = blocks(page or "")
    found = _unmarked(found, elements)
    if not found:
        return ""
    scores, links = _scores(found)
    least = THRESHOLD * max(scores.values())
    _weighed(found, elements, [len(text) if scores[element.path] >= least else 0 for text, element, _ in found])
    total = elements[0].content
    named = [e for e in elements if e.name in ("article", "main") and 2 * e.content > total]
    if named:
        most = max(e.content for e in named)
        chosen = max((e for e in named if e.content >= HOLDS * most), key=lambda e: e.depth)
    else:
        chosen = max((e for e in elements if e.content >= HOLDS * total), key=lambda e: e.depth)
        if chosen.name in ("p", "li", "td", "pre", "blockquote") and chosen.parent:
            chosen = chosen.parent
    for e in elements:
        e.inside = e is chosen or bool(e.parent) and e.parent.inside
    # A container's own short blocks belong to it, unless their path is one of links.
    kept = [scores[e.path] >= least or e.inside and (e.path not in links or _heading(e)) for _, e, _ in found]
    first, last = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    plain = [2 * linked < len(text) for text, _, linked in found]
    # The title: the nearest heading before the first block, with what is between them.
    at = first - 1
    while at >= 0 and plain[at] and not _heading(found[at][1]):
        at -= 1
    while at >= 0 and _heading(found[at][1]):
        first, at = at, at - 1
    return "\n\n".join(text for k, (text, element, _) in enumerate(found) if kept[k] or first <= k <= last and (plain[k] or _heading(element)))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(extract, "page_id long, url string, text string, n_chars long")
