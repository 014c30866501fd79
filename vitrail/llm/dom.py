"""DOM leaf blocks of an HTML page, by one tolerant pass over its tags."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style template title head".split())
INLINE = frozenset("b i em strong span a font u".split())
BLOCK = frozenset(
    "address article aside blockquote body br button center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html iframe label legend li main menu nav noscript object ol optgroup option p "
    "pre search section select summary svg table tbody td textarea tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - set("br button html body label option optgroup select legend iframe noscript object svg textarea".split())
KEEPS_P = ("button", "td", "th", "table", "li", "article", "section", "div")
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "tbody", "thead", "tfoot")),
    "td": (("td",), ("tr", "table")),
    "th": (("th",), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^>]*(?:>|\Z)|<",
    re.S,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An open element: what it adds to its ancestors' features.  Blocks share
    the nodes of their ancestors, so a page of any depth takes linear room."""

    __slots__ = ("parent", "lead", "fresh", "score")

    def __init__(self, parent: Node | None, lead: str, fresh: tuple[str, ...]):
        self.parent, self.lead, self.fresh, self.score = parent, lead, fresh, None


@dataclass
class Block:
    text: str
    node: Node | None  # the innermost open element
    linked: int  # characters inside links


class _Stack:
    """Open elements, with the places of each tag, so that every question about
    them takes constant time."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.features: dict[str, int] = {}  # how many open elements have each
        self.added: list[list[str]] = []
        self.links = 0

    def node(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def last(self, *tags: str) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        above = self.node()
        features = ["name=" + w for w in names]
        if tag not in ("html", "body"):
            features.append("in=" + tag)
        held, fresh = self.features, []
        for f in features:
            if not held.get(f):
                fresh.append(f)
            held[f] = held.get(f, 0) + 1
        # the tag of a block is its nearest element that is not mere formatting
        lead = above.lead if tag in INLINE and above and above.lead not in INLINE else tag
        self.places.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(Node(above, lead, tuple(fresh)))
        self.added.append(features)
        self.links += tag == "a"

    def pop_to(self, i: int) -> None:
        while len(self.tags) > i:
            tag = self.tags.pop()
            self.nodes.pop()
            self.places[tag].pop()
            for f in self.added.pop():
                self.features[f] -= 1
            self.links -= tag == "a"
        while self.blocks and self.blocks[-1] >= i:
            self.blocks.pop()


def _names(attributes: str) -> tuple[str, ...]:
    out = []
    for m in _ATTR.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        out += [w.lower() for w in _WORD.findall(value)]
    return tuple(dict.fromkeys(out))


def blocks(html: str | None) -> list[Block]:
    """Text between block-level tags, in page order; character references are
    decoded and white space inside a block becomes one space.  Empty blocks, scripts,
    styles, templates, comments and the head are left out; unclosed tags are fine."""
    html = html or ""
    stack = _Stack()
    out: list[Block] = []
    parts: list[str] = []
    linked = 0
    lower: str | None = None
    absent: set[str] = set()  # strings that do not come any more

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.node(), min(linked, len(text))))
            parts.clear()
        linked = 0

    def say(s: str) -> None:
        nonlocal linked
        if s:
            s = unescape(s)
            parts.append(s)
            if stack.links:
                linked += len(s.strip())

    def find(what: str, at: int) -> int:
        nonlocal lower
        if what in absent:
            return -1
        if lower is None:
            lower = html.lower() if len(html.lower()) == n else html
        found = lower.find(what, at)
        if found < 0:
            absent.add(what)
        return found

    pos, n = 0, len(html)
    while pos < n:
        m = _TOKEN.search(html, pos)
        if not m:
            say(html[pos:])
            break
        say(html[pos : m.start()])
        pos = m.end()
        token, tag = m[0], m[1]
        if tag is None:
            if token == "<":
                say("<")
            continue
        tag = tag.lower()
        if token[1] == "/":
            i = stack.last(tag)
            if tag in BLOCK:
                flush()
            elif i < 0 or stack.blocks and stack.blocks[-1] > i:
                continue  # an inline end tag does not close blocks
            if i >= 0:
                stack.pop_to(i)
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                end = find(f"</{tag}", pos)
                body = find("<body", pos) if tag == "head" else -1
                if body >= 0 and (end < 0 or body < end):
                    pos = body
                elif tag != "head" or end >= 0:
                    close = html.find(">", end) if end >= 0 else -1
                    pos = close + 1 if close >= 0 else n
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P and (i := stack.last("p")) >= 0 and i > stack.last(*KEEPS_P):
                stack.pop_to(i)
            if tag in SIBLINGS:
                same, within = SIBLINGS[tag]
                if (i := stack.last(*same)) > stack.last(*within):
                    stack.pop_to(i)
        if tag not in VOID and not token.endswith("/>"):
            stack.push(tag, _names(m[2]) if m[2] else ())
    flush()
    return out
