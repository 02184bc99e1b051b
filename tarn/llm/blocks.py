"""Web pages to sequences of text blocks, and blocks to vectors."""

from __future__ import annotations

import html
import re
import zlib
from dataclasses import dataclass

import numpy as np

# Names of the HTML standard, and words that sites put in class, id and role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"head", "script", "style", "noscript", "template", "iframe", "noembed", "noframes", "svg", "math", "object", "canvas", "audio", "video", "textarea", "title", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup",
    "option", "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
INLINE = {"a", "b", "i", "em", "strong", "span", "label", "small", "code", "time"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
LISTS = {"ul", "ol", "dl", "table", "select", "menu"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template", "head"}
IN_TABLE = {"table", "caption", "tbody", "tfoot", "thead", "td", "th", "tr"}
#: An end tag closes nothing beyond one of these, unless it belongs to a table itself.
SCOPES = {"table", "td", "th", "caption", "html"}
KEYS = [
    "ad", "ads", "advert", "advertisement", "alert", "archive", "article", "author", "banner", "body", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent",
    "content", "contentinfo", "cookie", "cookies", "copyright", "dialog", "disclaimer", "discussion", "disqus", "entry", "feedback", "footer", "form", "gdpr", "header", "hidden", "legal", "links", "login",
    "main", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "page", "pager", "pagination", "popup", "post", "privacy", "promo", "promotion", "recommended",
    "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "signup", "site", "skip", "social", "sponsor", "sponsored", "story", "subscribe", "tags", "text", "toolbar", "top",
    "trending", "warning", "widget",
]

TAGS = sorted(BLOCK | INLINE)
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_KEY_AT = {k: len(TAGS) + i for i, k in enumerate(KEYS)}
N_PATH = len(TAGS) + len(KEYS)
N_LEAF = len(TAGS)
N_WORDS = 64
N_PLAIN = 8
N_INPUT = N_PATH + N_LEAF + N_WORDS + N_PLAIN

_SPACE = " \t\n\f\r"
# a quote opens a string only behind "="; one that is never closed is a letter like any other
_ATTRIBUTE = rf"""[{_SPACE}/]*+[^{_SPACE}/>][^{_SPACE}/>=]*+(?:[{_SPACE}]*+=[{_SPACE}]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^{_SPACE}>]*+))?+"""
_TAG = re.compile(rf"<(/?)([a-zA-Z][^{_SPACE}/>]*+)((?:{_ATTRIBUTE})*+)([{_SPACE}/]*+)>")
_NOTE = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*(?:>|\Z)", re.DOTALL)
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[{_SPACE}/>])[^>]*(?:>|\Z)", re.IGNORECASE) for t in RAW}


@dataclass
class Block:
    """Text between two borders of blocks, with what stands above it."""

    text: str
    leaf: int
    path: tuple[int, ...]
    linked: int


def _path_ids(tag: str, attrs: str) -> tuple[int, ...]:
    ids = [_TAG_AT[tag]] if tag in _TAG_AT else []
    if attrs and ("=" in attrs):
        for m in _NAMES.finditer(attrs):
            for word in _PARTS.findall(m[1] or m[2] or m[3] or ""):
                if (i := _KEY_AT.get(word.lower())) is not None:
                    ids.append(i)
    return tuple(ids)


class _Open:
    """The open elements. Places by name and running counts of path parts make every step independent of the depth."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, tuple[int, ...]]] = []
        self.at: dict[str, list[int]] = {}
        self.groups: dict[str, list[int]] = {"block": [], "own": [], "scope": []}
        self.path: dict[int, int] = {}
        self.dropped = 0
        self.links: list[int] = []

    @staticmethod
    def _groups(tag: str) -> list[str]:
        own = tag in CLOSES_OWN or tag in LISTS
        return ["block"] * (tag in BLOCK) + ["own"] * own + ["scope"] * (tag in SCOPES)

    def push(self, tag: str, attrs: str) -> None:
        ids = _path_ids(tag, attrs)
        k = len(self.stack)
        self.stack.append((tag, ids))
        self.at.setdefault(tag, []).append(k)
        for g in self._groups(tag):
            self.groups[g].append(k)
        for i in ids:
            self.path[i] = self.path.get(i, 0) + 1
        self.dropped += tag in DROPPED
        if tag == "a":
            self.links.append(k)

    def cut(self, size: int) -> None:
        """Closes all elements from place ``size`` on."""
        while len(self.stack) > size:
            tag, ids = self.stack.pop()
            self.at[tag].pop()
            for g in self._groups(tag):
                self.groups[g].pop()
            for i in ids:
                self.path[i] -= 1
                if not self.path[i]:
                    del self.path[i]
            self.dropped -= tag in DROPPED
        while self.links and self.links[-1] >= size:
            self.links.pop()

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def group(self, name: str) -> int:
        return self.groups[name][-1] if self.groups[name] else -1

    def leaf(self) -> int:
        k = self.group("block")
        return _TAG_AT[self.stack[k][0] if k >= 0 else "body"]

    def end(self, tag: str) -> None:
        """An end tag, as far as it reaches: inline ones don't close blocks, others no table cell around them."""
        if tag in ("html", "body"):  # what follows still belongs to the body
            return
        k = max(map(self.last, HEADINGS)) if tag in HEADINGS else self.last(tag)
        if k < 0:
            return
        if tag in IN_TABLE:
            if k >= self.last("table"):
                self.cut(k)
        elif tag in BLOCK or tag in DROPPED:
            if k >= self.group("scope") or tag in DROPPED:
                self.cut(k)
        elif k > self.group("block"):
            self.cut(k)
        elif tag == "a" and self.links:
            self.links.pop()

    def implied(self, tag: str) -> None:
        """Closes what a start tag ends without an end tag of its own."""
        head = self.last("head")
        if head >= 0 and tag not in IN_HEAD and self.dropped == 1:
            self.cut(head)
        if tag in CLOSES_P and self.group("block") >= 0 and self.stack[self.group("block")][0] == "p":
            self.cut(self.group("block"))
        if tag in HEADINGS and self.stack and self.stack[-1][0] in HEADINGS:
            self.cut(len(self.stack) - 1)
        for k in reversed(self.groups["own"] if tag in CLOSES_OWN else ()):
            if self.stack[k][0] in CLOSES_OWN[tag]:
                self.cut(k)
                # a row also ends the cell that it stands in
                if tag == "tr" and (n := self.group("own")) >= 0 and self.stack[n][0] == "tr":
                    self.cut(n)
                break
            if self.stack[k][0] in LISTS:
                break


def parse(page: str) -> list[Block]:
    """The blocks of a page in order, white space collapsed, references decoded, empty ones left out.

    Comments, scripts, styles, the head and embedded media never reach a block. End tags that are missing are
    implied as the standard does for the head, paragraphs, headings, list items and cells; other open tags end with their parent.
    Nesting may be as deep as it likes; a tag that the page's end cuts off is no text.
    """
    out: list[Block] = []
    tree = _Open()
    text: list[str] = []
    linked = 0
    pos = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                out.append(Block(joined, tree.leaf(), tuple(sorted(tree.path)), min(linked, len(joined))))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw and tree.dropped == 1 and tree.stack[-1][0] == "head" and not raw.isspace():
            tree.cut(len(tree.stack) - 1)  # text ends the head
        if raw and not tree.dropped:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if tree.links:
                linked += len(raw)

    n = len(page)
    while pos < n:
        found = _OPEN.search(page, pos)
        if not found:
            add(page[pos:])
            break
        add(page[pos : found.start()])
        pos = found.start()
        m = _TAG.match(page, pos)
        if m is None:  # a comment, a declaration, or a tag that never ends
            note = _NOTE.match(page, pos)
            pos = note.end() if note else n
            continue
        pos = m.end()
        end, tag, attrs = m[1], m[2].lower(), m[3]
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCK:
            flush()
        if end:
            tree.end(tag)
            continue
        tree.implied(tag)
        if tag in VOID or (tag in ("html", "body", "head") and tag in tree.at and (tree.at[tag] or tag != "head")):
            continue
        if "/" in m[4] and tag in ("svg", "math", "iframe", "object", "template"):
            continue
        if tag in RAW:
            close = _RAW_END[tag].search(page, pos)
            pos = close.end() if close else n
            continue
        tree.push(tag, attrs)
    flush()
    return out


def vectors(blocks: list[Block]) -> np.ndarray:
    """A row for each block: path (multi-hot), leaf (one-hot), hashed words (signed, 32 places) and eight plain numbers."""
    n = len(blocks)
    x = np.zeros((n, N_INPUT), np.float32)
    rows, cols = [], []
    plain = np.zeros((n, N_PLAIN), np.float32)
    hashes, sizes = [], []
    for k, b in enumerate(blocks):
        rows += [k] * len(b.path)
        cols += b.path
        x[k, N_PATH + b.leaf] = 1
        words = b.text.lower().encode("utf-8", "replace").split()
        hashes += map(zlib.crc32, words)
        sizes.append(len(words))
        size, w = len(b.text), max(1, len(words))
        stops = b.text.count(".") + b.text.count("!") + b.text.count("?")
        plain[k] = (np.log1p(size) / 8, b.linked / size, np.log1p(w) / 6, stops / w, b.text.count(",") / w, size / w / 10, b.text[-1:] in ".!?\"'", 1)
    x[rows, cols] = 1
    h = np.array(hashes, np.int64)
    own = np.repeat(np.arange(n), sizes)
    bag = np.bincount(own * N_WORDS + h % N_WORDS, np.where(h >> 8 & 1, 1.0, -1.0), n * N_WORDS).reshape(n, N_WORDS)
    x[:, N_PATH + N_LEAF : N_PATH + N_LEAF + N_WORDS] = bag / np.sqrt(np.maximum(1, sizes))[:, None]
    x[:, -N_PLAIN:] = plain
    return x
