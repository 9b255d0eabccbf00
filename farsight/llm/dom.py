"""A forgiving HTML reader that runs in linear time and gives block elements with their texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is raw text that never shows.
RAW = ("script", "style", "template", "noscript", "textarea", "title", "iframe", "svg", "math")
HIDDEN = frozenset((*RAW, "head", "select", "datalist", "object", "canvas"))
# What may stand in head; text and any other start tag end it, as its end tag may be left out.
IN_HEAD = frozenset((*RAW[:4], "title", "html", "head", "base", "link", "meta", "basefont", "bgsound", "noframes"))
# Hidden elements that hide nothing where their end tag is missing.
PAIRED = ("select", "datalist", "object", "canvas")
# Elements that interrupt a line of text.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
# A start tag of the key ends an open element of these names at the top of its scope.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr"),
}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TOKEN = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}

_PAIRS = re.compile(rf"<(/?)({'|'.join(PAIRED)})(?=[\s/>])", re.I)


@dataclass
class Node:
    """A block element: its place in the tree, attribute words and what its own lines hold."""

    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    own: int = 0  # characters of its own lines
    links: int = 0  # of them in links
    stops: int = 0  # of them full stops, commas and the like
    lines: int = 0
    children: list[int] = field(default_factory=list)


class Page:
    """Nodes in page order (parents first) and lines (node, text) in page order."""

    def __init__(self) -> None:
        self.nodes: list[Node] = [Node("#", -1, 0)]
        self.lines: list[tuple[int, str]] = []


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """The place of the ``>`` that ends the tag that starts before ``at``; quoted ones do not count."""
    while True:
        stop = _STOP.search(html, at)
        if stop is None:
            return len(html)
        mark = stop.group()
        if mark == ">":
            return stop.start()
        close = -1 if mark in unclosed else html.find(mark, stop.end())
        if close < 0:
            unclosed.add(mark)
            at = stop.end()
        else:
            at = close + 1


def attribute_tokens(tag_text: str) -> tuple[str, ...]:
    """All lower-case words of class, id, role, itemprop and label values."""
    found = []
    for name, a, b, c in _ATTRIBUTE.findall(tag_text):
        found += _TOKEN.findall((a or b or c).lower())
    return tuple(found)


def _ended(html: str) -> set[int]:
    """Places of the start tags of paired elements that have an end tag of their own."""
    found: set[int] = set()
    waiting: dict[str, list[int]] = {name: [] for name in PAIRED}
    for tag in _PAIRS.finditer(html):
        starts = waiting[tag[2].lower()]
        if not tag[1]:
            starts.append(tag.start())
        elif starts:
            found.add(starts.pop())
    return found


def parse(html: str) -> Page:
    """Reads any text as a page; each character is looked at a bounded number of times."""
    page = Page()
    nodes, lines = page.nodes, page.lines
    # Open elements: (name, node for blocks or -1, whether it hides). ``opened`` counts names; the index stacks tell
    # whether an open <p> lies above the innermost container.
    stack: list[tuple[str, int, bool]] = []
    opened: dict[str, int] = {}
    blocks = [0]
    hidden = links = 0
    text: list[str] = []
    link_chars = 0
    unclosed: set[str] = set()
    ended: set[int] | None = None

    def flush() -> None:
        nonlocal link_chars
        if text:
            line = " ".join("".join(text).split())
            text.clear()
            if line:
                node = nodes[blocks[-1]]
                lines.append((blocks[-1], line))
                node.own += len(line)
                node.links += min(link_chars, len(line))
                node.stops += line.count(".") + line.count(",") + line.count(";") + line.count("?") + line.count("!")
                node.lines += 1
        link_chars = 0

    def close_top() -> None:
        nonlocal hidden, links
        name, node, hides = stack.pop()
        opened[name] -= 1
        if node >= 0:
            flush()
            blocks.pop()
        if hides:
            hidden -= 1
        elif name == "a":
            links -= 1

    def close_head() -> None:
        while stack[-1][0] != "head":
            close_top()
        close_top()

    at, n = 0, len(html)
    while at < n:
        less = html.find("<", at)
        if less < 0:
            less = n
        if hidden and stack[-1][0] == "head" and html[at:less].strip():
            close_head()
        if less > at and not hidden:
            piece = html[at:less]
            piece = unescape(piece) if "&" in piece else piece
            text.append(piece)
            if links:
                link_chars += len(piece.strip())
        if less >= n:
            break
        following = html[less + 1 : less + 2]
        if following == "!" or following == "?":
            if html.startswith("<!--", less):
                end = html.find("-->", less + 4)
                at = n if end < 0 else end + 3
            else:
                end = html.find(">", less)
                at = n if end < 0 else end + 1
            continue
        ending = following == "/"
        match = _NAME.match(html, less + 1 + ending)
        if match is None:
            if not hidden:
                text.append("<")
            at = less + 1
            continue
        name = match.group().lower()
        end = _tag_end(html, match.end(), unclosed)
        at = end + 1
        if ending:
            if opened.get(name):
                while stack[-1][0] != name:
                    close_top()
                close_top()
            elif name in BLOCKS and not hidden:
                flush()
            continue
        if opened.get("head") and name not in IN_HEAD:
            close_head()
        if name == "br":
            text.append("\n")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        hides = name in HIDDEN
        if name in PAIRED:
            ended = _ended(html) if ended is None else ended
            hides = less in ended
        if name in BLOCKS:
            flush()
            # Inline elements left open end with their paragraph or item.
            ends = CLOSES.get(name, ())
            if opened.get("p") and name not in ("option", "select", "button", "legend"):
                ends = (*ends, "p")
            top = nodes[blocks[-1]].tag
            while top in ends and opened.get(top):
                while stack[-1][0] != top:
                    close_top()
                close_top()
                top = nodes[blocks[-1]].tag
            head = html[match.end() : end]
            parent = blocks[-1]
            node = Node(name, parent, nodes[parent].depth + 1, attribute_tokens(head) if "=" in head else ())
            nodes[parent].children.append(len(nodes))
            blocks.append(len(nodes))
            stack.append((name, len(nodes), hides))
            nodes.append(node)
        else:
            stack.append((name, -1, hides))
        opened[name] = opened.get(name, 0) + 1
        if hides:
            hidden += 1
        elif name == "a":
            links += 1
        if name in _RAW_END:
            raw_end = None if name in unclosed else _RAW_END[name].search(html, at)
            if raw_end is None:
                # Never ended: what follows is read as markup, and shows.
                unclosed.add(name)
                close_top()
            else:
                at = raw_end.start()
    while stack:
        close_top()
    flush()
    return page
