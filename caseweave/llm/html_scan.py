"""A small tolerant HTML scanner: what the extraction and media operators read pages with."""

from __future__ import annotations

import html
import re

#: What follows the name of a tag: values are quoted only right after the equals sign, quotes elsewhere are plain characters (fixed pattern).
GIVEN = r"(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>]*)|[^>=])*"
#: One markup item: comment, declaration, stray end, or tag with its attributes (fixed pattern).
ITEM = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</(?![A-Za-z])[^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)({GIVEN})(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?", re.S)
#: Elements whose content is no markup.
RAW = {"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes", "plaintext"}
#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that begin and end a block of text.
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: What the start of an element ends, if it is open (within the nearest of the second set).
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Elements out of which no other end tag reaches.
SCOPE = {"article", "aside", "body", "footer", "header", "html", "main", "nav", "section", "table", "td", "th", "form", "div", "ul", "ol", "figure", "blockquote"}


def attributes(raw: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(raw):
        found.setdefault(m[1].lower(), html.unescape(next((x for x in m.groups()[1:] if x is not None), "")))
    return found


class _Open:
    """The open elements, the innermost last. Every search goes outwards and stops at the first element that bounds it."""

    def __init__(self):
        self.names: list[str] = []
        self.counts: dict[str, int] = {}

    def push(self, name: str) -> None:
        self.names.append(name)
        self.counts[name] = self.counts.get(name, 0) + 1

    def pop_to(self, k: int):
        """End all elements from the k-th on."""
        while len(self.names) > k:
            name = self.names.pop()
            self.counts[name] -= 1
            yield "end", name

    def nearest(self, wanted: set[str], within: set[str]) -> int | None:
        """The innermost element of `wanted`, unless one of `within` lies inside it."""
        if any(self.counts.get(x) for x in wanted):
            for k in range(len(self.names) - 1, -1, -1):
                if self.names[k] in wanted:
                    return k
                if self.names[k] in within:
                    return None
        return None


def events(page: str):
    """("text", decoded text), ("start", name, raw attributes) and ("end", name) in page order; every start but a void element's has its end.

    Text of script, style and the like comes as ("raw", name, text). Unclosed elements end with what holds them,
    a new paragraph or block ends an open paragraph, and stray end tags are passed over.
    """
    at, n, open_ = 0, len(page), _Open()
    while at < n:
        m = ITEM.search(page, at)
        upto = m.start() if m else n
        if upto > at:
            yield "text", html.unescape(page[at:upto])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            k = open_.nearest({name}, set() if name in SCOPE else SCOPE)
            if k is not None:
                yield from open_.pop_to(k)
            continue
        if name in BLOCK:
            k = open_.nearest({"p"}, SCOPE)
            if k is not None:
                yield from open_.pop_to(k)
        if name in ENDS:
            k = open_.nearest(*ENDS[name])
            if k is not None:
                yield from open_.pop_to(k)
        raw = m[3] or ""
        yield "start", name, raw
        if name in VOID:
            continue
        if name in RAW and not raw.endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I).search(page, at)
            yield "raw", name, page[at : close.start()]
            yield "end", name
            at = close.end()
            continue
        open_.push(name)
    yield from open_.pop_to(0)
