"""A lenient DOM for text extraction: elements and text runs of a page in order, with parents. Runs inside tasks.

Decoding, raw-text elements and the implied ends of paragraphs, list items, table parts and options follow the HTML standard as far as
they matter for which text stands in which block.
"""

from __future__ import annotations

import html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"  # quotes delimit only directly after =
    r"((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?+)*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[a-z]+")
PART = "-"  # before words of a longer class or id

# Fixed values of the HTML standard.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
RAW = frozenset(["script", "style", "textarea", "title", "noscript", "iframe", "template"])
BLOCK = frozenset(
    ["address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
     "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend",
     "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "textarea", "tfoot",
     "th", "thead", "title", "tr", "ul"]
)
CLOSES = {  # an open element that a start tag ends, and what shields it
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = frozenset(["p"])
_SHIELD = frozenset(["button", "td", "th", "caption", "html", "body", "table", "object"])


class Page:
    """Nodes in page order: ``parent``, ``kind`` (tag or ``#text``), ``marks`` (words of class, id and role), ``text`` and ``block``."""

    __slots__ = ("parent", "kind", "marks", "text", "block")

    def __init__(self):
        self.parent, self.kind, self.marks, self.text, self.block = [-1], ["#root"], [()], [""], [0]

    def add(self, parent: int, kind: str, marks: tuple = (), text: str = "", block: int = 0) -> int:
        self.parent.append(parent)
        self.kind.append(kind)
        self.marks.append(marks)
        self.text.append(text)
        self.block.append(block)
        return len(self.parent) - 1


def marks_of(attributes: str) -> tuple[str, ...]:
    """Lower-case words of class, id and role, and ``hidden``. Words of a name of several (``has-sidebar``) say less and begin with ``PART``."""
    found = []
    for name, *values in _ATTRIBUTE.findall(attributes):
        value, name = "".join(values).lower(), name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            found.append("hidden")
        elif name != "aria-hidden":
            for token in value.split():
                words = _WORD.findall(token)
                found += words if len(words) == 1 else [PART + word for word in words]
    return tuple(dict.fromkeys(found))


def parse(source: str) -> Page:
    """All elements and text runs of a page. Text of raw elements (scripts, styles and the like) stays undecoded in one run."""
    page, stack, at, block = Page(), [0], 0, 0
    names = ["#root"]

    def put(text: str, decode: bool = True) -> None:
        if text:
            page.add(stack[-1], "#text", (), html.unescape(text) if decode and "&" in text else text, block)

    def end(depth: int) -> None:
        nonlocal block
        if any(n in BLOCK for n in names[depth:]):
            block += 1
        del stack[depth:], names[depth:]

    for m in iter(lambda: _TOKEN.search(source, at), None):
        put(source[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            depth = next((d for d in range(len(names) - 1, 0, -1) if names[d] == tag), 0)
            if depth:
                end(depth)
            elif tag in BLOCK:
                block += 1
            continue
        if tag in BLOCK:
            ends, shield = CLOSES.get(tag, (_P, _SHIELD)) if tag in CLOSES else (_P, _SHIELD)
            for d in range(len(names) - 1, 0, -1):
                if names[d] in ends:
                    end(d)
                    break
                if names[d] in shield:
                    break
            block += 1
        marks = marks_of(m[3]) if "=" in m[3] or "hidden" in m[3] else ()
        node = page.add(stack[-1], tag, marks)
        if tag == "br":
            page.add(stack[-1], "#text", (), "\n", block)
        if tag in VOID:
            continue
        stack.append(node)
        names.append(tag)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            put(source[at : close.start() if close else len(source)], tag in ("title", "textarea"))
            at = close.end() if close else len(source)
            end(len(names) - 1)
    put(source[at:])
    return page
