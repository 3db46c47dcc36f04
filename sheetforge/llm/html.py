"""HTML main-text extraction by tag-path ratios.

Every text block of a page has a root-to-leaf tag path. Per path the text length per block and the share of
punctuation are aggregated, smoothed over the blocks in page order, and multiplied. Paths above
a threshold are content paths; the smallest element that holds all of their text and the heading before it is the
article (or all <article> and <main> elements together, where they hold most text), and all its blocks are kept but those inside menus, forms, adverts, comments and the like.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"  # a comment
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"  # a tag
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"  # a tag with an open quote
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z",  # a declaration, a tag that the end cuts off
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_PUNCTUATION = re.compile(r"[,.;:!?，。；：！？、…]")

RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Formatting tags change neither blocks nor paths.
INLINE = {"b", "i", "em", "strong", "u", "s", "strike", "small", "big", "font", "tt", "code", "nobr", "mark", "sub", "sup", "abbr", "cite", "q", "kbd", "samp", "var", "time", "dfn", "del", "ins", "bdi", "bdo"}
#: These are tracked, but text on both sides of them is one block.
RUN_ON = {"a", "span", "label", "ruby", "rt", "rp", "data", "output", "picture", "img"}
BOILERPLATE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "option", "datalist", "fieldset", "dialog", "menu", "template", "svg", "canvas", "object", "audio", "video", "map", "head", "search"}
BOILERPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "status"}
#: Names of classes and ids. A name counts as a whole class, as the last part of one ("site-footer"), or before a part of PLACES ("comment-list").
BOILERPLATE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "aside", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "topbar",
    "comment", "comments", "disqus", "reply", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "subscription", "signup", "login", "social", "share", "sharing", "related", "recommended", "recommendations", "widget", "widgets",
    "toolbar", "pagination", "pager", "copyright", "skip", "hidden",
}
PLACES = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "form", "group", "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "right", "row", "section", "slot", "thread", "top", "unit", "wrap", "wrapper", "zone"}
#: Parts that make a class name a statement about something else ("with-sidebar", "category-advertising").
STATEMENTS = {"with", "without", "no", "not", "non", "has", "have", "is", "hide", "show", "category", "tag", "topic", "format", "type", "in", "on", "off", "after", "before"}
#: Inside an article these are parts of it.
OF_ARTICLES = {"header", "alert"}
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A new tag of the key closes an open tag of the values, up to the nearest tag in _SCOPE.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "a": {"a"}}
_SCOPE = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "main", "section", "div", "td", "th"}


class _Node:
    """An element. ``path`` is a hash of the tags from the root, ``block`` the nearest element that is no run-on one, ``named`` the nearest one
    (itself or above) whose class or id names boilerplate. Of the latter, ``text`` is the unlinked text that it holds and ``title`` tells whether it holds an article's start."""

    __slots__ = ("block", "boiler", "dropped", "holds", "in_article", "linked", "named", "named_above", "number", "parent", "path", "tag", "text", "title")

    def __init__(self, tag: str, parent: _Node | None, kind: str | None, number: int) -> None:
        self.tag, self.parent, self.number, self.holds = tag, parent, number, 0
        self.text, self.title, self.dropped = 0.0, False, False
        self.boiler = kind == "sure" or (parent is not None and parent.boiler)
        self.named_above = parent.named if parent else None
        self.named = self if kind == "named" else self.named_above
        self.path = hash((parent.path if parent else 0, tag))
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.block = parent.block if parent is not None and tag in RUN_ON else self
        self.linked = 3 if tag == "a" else max(0, parent.linked - 1) if parent else 0  # links reach two elements down


class _Stack:
    """The open elements, with the places of each tag, of elements that are no run-on ones, and of those that no open paragraph reaches over: no search walks through the elements."""

    def __init__(self, root: _Node) -> None:
        self.nodes, self.solid, self.firm = [root], [0], [0]
        self.places: dict[str, list[int]] = {"": [0]}

    def push(self, node: _Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.places.setdefault(node.tag, []).append(at)
        if node.tag not in RUN_ON:
            self.solid.append(at)
            if node.tag != "p" and node.tag not in HEADINGS:
                self.firm.append(at)

    def close_from(self, at: int) -> None:
        while len(self.nodes) > at:
            self.places[self.nodes.pop().tag].pop()
        for some in (self.solid, self.firm):
            while some[-1] >= at:
                some.pop()

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, 0 for none."""
        return (self.places.get(tag) or [0])[-1]

    def close_siblings(self, tag: str) -> None:
        """Ends what a new element of the tag ends: from the outermost such element above the nearest scope."""
        ended = CLOSES[tag]
        scope = max(self.last(t) for t in _SCOPE - ended)
        found = [places[i] for t in ended if (places := self.places.get(t)) and (i := bisect_right(places, scope)) < len(places)]
        if found:
            self.close_from(min(found))


def _names_boilerplate(value: str, in_article: bool) -> bool:
    words = BOILERPLATE_WORDS - OF_ARTICLES if in_article else BOILERPLATE_WORDS
    for name in value.split():
        parts = [p.lower() for p in _WORD.findall(name)]
        if not parts or STATEMENTS.intersection(parts):
            continue
        if parts[-1] in words or (len(parts) > 1 and parts[0] in words and all(p in PLACES or p in words for p in parts[1:])):
            return True
    return False


def _boilerplate(tag: str, attributes: str, in_article: bool) -> str | None:
    """"sure" by tag, role or style; "named" by a class or id, which the text that the element holds can overrule; None."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and not in_article):
        return "sure"
    if not attributes or tag in ("html", "body", "main"):
        return None
    named = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            named = named or _names_boilerplate(value, in_article)
        elif (name == "role" and value.lower() in BOILERPLATE_ROLES) or name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "sure"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "sure"
    if not named:
        return None
    return "sure" if tag in RUN_ON else "named"


def _drop_named(named: list[_Node], blocks: list[tuple[_Node, str, float]]) -> list[tuple[_Node, str, float]]:
    """``blocks`` without those in elements that a class or id names, unless such an element holds the page's text.

    It does if it holds nine tenths of the unlinked text, or half of it and an article's start (h1, article, main). ``named``: all such elements,
    parents first.
    """
    total = 0.0
    for node, text, link in blocks:
        size = len(text) * (1 - link)
        total += size
        if node.named is not None:
            node.named.text += size
    for node in reversed(named):
        if node.named_above is not None:
            node.named_above.text += node.text
            node.named_above.title |= node.title
    for node in named:
        kept = node.text >= 0.9 * total or (node.title and node.text >= 0.5 * total)
        node.dropped = not kept or (node.named_above is not None and node.named_above.dropped)
    return [b for b in blocks if b[0].named is None or not b[0].named.dropped]


def text_blocks(page: str) -> list[tuple[_Node, str, float]]:
    """(element, text, share of it in links) of each block of a page outside boilerplate, in page order."""
    stack, blocks, made = _Stack(_Node("", None, None, 0)), [], 0
    named: list[_Node] = []
    parts: list[str] = []
    linked = [0]

    def flush(node: _Node) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not node.boiler:
                blocks.append((node, text, min(1.0, linked[0] / len(text))))
            parts.clear()
            linked[0] = 0

    def say(text: str) -> None:
        top = stack.nodes[-1]
        if text and not (top.boiler and not text.strip()):
            if top.boiler and not top.block.boiler:  # an inline advert in an article block
                return
            parts.append(text)
            if top.linked:
                linked[0] += len(text.strip())

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        attributes = m[3] or m[6] or ""
        if tag in INLINE:
            continue
        if tag in RAW and not closing:
            if tag not in ("textarea", "title", "xmp") and attributes.rstrip().endswith("/") and tag not in ("script", "style"):
                continue
            close = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = page.find(">", close.end()) + 1 if close else 0
            at = at or end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in RUN_ON:
            flush(stack.nodes[-1].block)
        if tag in VOID:
            continue
        if closing:
            last = stack.last(tag)
            if last and (tag not in RUN_ON or last > stack.solid[-1]):
                stack.close_from(last)
            continue
        if tag in CLOSES:
            stack.close_siblings(tag)
        if tag not in RUN_ON and (last := stack.last("p")) > stack.firm[-1]:  # a block ends an open paragraph
            stack.close_from(last)
        if attributes.endswith("/") and tag in RUN_ON:
            continue
        made += 1
        above = stack.nodes[-1]
        node = _Node(tag, above, _boilerplate(tag, attributes, above.in_article), made)
        if node.named is node:
            named.append(node)
        if tag in ("h1", "article", "main") and node.named is not None:
            node.named.title = True
        stack.push(node)
    flush(stack.nodes[-1].block)
    return _drop_named(named, blocks)


def path_scores(blocks: list[tuple[_Node, str, float]]) -> dict[int, float]:
    """Tag path -> fused ratio: smoothed text length per block times smoothed punctuation share."""
    paths = [n.path for n, _, _ in blocks]
    chars: dict[int, list[float]] = {}
    for path, (_, text, link) in zip(paths, blocks, strict=True):
        total = chars.setdefault(path, [0.0, 0.0, 0.0])
        total[0] += len(text) * (1 - link)
        total[1] += len(_PUNCTUATION.findall(text))
        total[2] += 1
    length = np.array([chars[p][0] / chars[p][2] for p in paths])
    marks = np.array([(chars[p][1] + 0.1) / chars[p][2] for p in paths])
    kernel = np.array([0.25, 0.5, 0.25])

    def smooth(x: np.ndarray) -> np.ndarray:
        return np.convolve(np.concatenate((x[:1], x, x[-1:])), kernel, "valid")

    fused = smooth(length) * smooth(marks)
    sums: dict[int, list[float]] = {}
    for path, value in zip(paths, fused, strict=True):
        total = sums.setdefault(path, [0.0, 0.0])
        total[0] += value
        total[1] += 1
    return {p: s / n for p, (s, n) in sums.items()}


def main_text(page: str | None, *, threshold: float = 0.1) -> str:
    """Main text of a page: blocks joined by newlines; empty for null or when there is none.

    Content paths score at least ``threshold`` of the best path. Where at least half of the text outside links is in
    <article> and <main> elements, they are the article; else it is the smallest element that holds all blocks on content paths,
    with the last heading before it and what stands between them. Blocks of links on other paths go, and where no element marks the article so do
    those of its parts (div and section elements) that hold no content path. Inside a block white space is one space; character references are decoded.
    """
    if not page:
        return ""
    blocks = text_blocks(page)
    if not blocks:
        return ""
    inside = [b for b in blocks if b[0].in_article]
    unlinked = sum(len(t) * (1 - link) for _, t, link in blocks)
    whole = bool(inside) and 2 * sum(len(t) * (1 - link) for _, t, link in inside) >= unlinked
    if whole:
        blocks = inside
    scores = path_scores(blocks)
    best = max(scores.values())
    content = [i for i, (node, _, link) in enumerate(blocks) if scores[node.path] >= threshold * best and link < 1]
    if not content:
        return "\n".join(t for _, t, _ in blocks)
    menu = [link > 0.8 and scores[node.path] < threshold * best and not node.in_article for node, _, link in blocks]
    if whole:
        return "\n".join(t for (_, t, _), drop in zip(blocks, menu, strict=True) if not drop)
    heading = next((i for i in range(content[0], -1, -1) if blocks[i][0].tag in HEADINGS), content[0])
    # elements above any block, each once, in the order of their making: parents come before children
    above: dict[int, _Node] = {}
    for node, _, _ in blocks:
        up: _Node | None = node
        while up is not None and up.number not in above:
            above[up.number] = up
            up = up.parent
    order = [above[n] for n in sorted(above)]
    for i in content:
        blocks[i][0].holds += 1
    for node in reversed(order):
        if node.parent is not None:
            node.parent.holds += node.holds
    article = blocks[content[0]][0]
    while article.parent is not None and (article.holds < len(content) or article.tag in ("p", *HEADINGS, "li", "td", "th", "dd", "dt", "blockquote", "pre", "ul", "ol", "tr", "tbody", "table", "figure", "header")):
        article = article.parent
    inside_article: set[int] = set()
    for node in order:
        spare = node.tag in ("div", "section") and not node.holds and node.parent is article
        if node is article or (node.parent is not None and node.parent.number in inside_article and not spare):
            inside_article.add(node.number)
    kept = []
    for i, (node, text, _) in enumerate(blocks):
        if not menu[i] and (node.number in inside_article or heading <= i < content[0]):
            kept.append(text)
    return "\n".join(kept)


def extract_main_text(pages: DataFrame, *, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all but the page's) plus text and n_chars (code points).

    One row per row, in whole: null, empty or text-free pages give an empty text; very long pages are read to
    the end. Carried columns called text or n_chars are replaced.
    """
    names = [c for c in (carry if carry is not None else pages.columns) if c not in (html_col, "text", "n_chars")]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch[0].to_pylist()]
            arrays = [batch[i + 1] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*names, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in names)
    return pages.select(html_col, *names).mapInArrow(extract, f"{kinds}{', ' if names else ''}text string, n_chars long")
