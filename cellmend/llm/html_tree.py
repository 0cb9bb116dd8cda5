"""A forgiving HTML parser that keeps what text extraction needs: elements with parents, text in page order, block bounds."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_EVENT = re.compile("[>\"']")
#: Deeper elements hang on the one at this depth, as browsers do.
DEPTH = 512

# Fixed values of the HTML standard: elements without content, elements of running text, elements whose content is no markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: What an opening tag closes first, up to the elements that stop it.
_CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
_ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_P_STOPS = frozenset("td th table article section div main aside li button body".split())
_IN_HEAD = frozenset("base link meta title style script noscript template head html".split())


#: Text and running text directly in these make a block of their own, an element without a tag.
CONTAINERS = frozenset("#root html body div section article main aside header footer nav center td th form blockquote li dd".split())
TEXT = "#text"


@dataclass
class Tree:
    """Element 0 is the root. parts: (element, text) in page order, or (-1, "") where a block begins or ends."""

    tags: list[str] = field(default_factory=lambda: ["#root"])
    attrs: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])
    parts: list[tuple[int, str]] = field(default_factory=list)


class _Open:
    """The open elements, and where each tag stands among them, so that nothing is ever searched for."""

    def __init__(self, tree: Tree):
        self.tree, self.stack = tree, [0]
        self.where: dict[str, list[int]] = {"#root": [0]}

    @property
    def top(self) -> str:
        return self.tree.tags[self.stack[-1]]

    def push(self, tag: str, attrs: str, stays: bool = True) -> int:
        t, me = self.tree, len(self.tree.tags)
        t.tags.append(tag)
        t.attrs.append(attrs)
        t.parents.append(self.stack[min(len(self.stack), DEPTH) - 1])
        if stays:
            self.where.setdefault(tag, []).append(len(self.stack))
            self.stack.append(me)
        return me

    def cut(self, size: int) -> None:
        while len(self.stack) > size:
            self.where[self.tree.tags[self.stack.pop()]].pop()

    def last(self, names: frozenset[str]) -> int:
        return max((w[-1] for x in names if (w := self.where.get(x))), default=-1)

    def close(self, names: frozenset[str], stops: frozenset[str]) -> None:
        """Up to the innermost of names, unless one of stops is further in."""
        if (k := self.last(names)) > max(0, self.last(stops)):
            self.cut(k)

    def running(self) -> int:
        """The element that running text belongs to here."""
        if self.top in CONTAINERS:
            self.push(TEXT, "")
        return self.stack[-1]

    def block(self) -> None:
        """A block begins or ends here."""
        if self.top == TEXT:
            self.cut(len(self.stack) - 1)
        self.tree.parts.append((-1, ""))


class _Ends:
    """Where opening tags end: at the first '>' outside quotes, or at the first of all where quotes do not close. Every quote that
    led to no end is remembered, so the whole page costs linear time."""

    def __init__(self, html: str):
        self.html, self.dead = html, set()

    def __call__(self, at: int) -> int:
        """The place of the '>' of the tag whose name ends at `at`, or -1."""
        html, pos, opened = self.html, at, []
        while (m := _EVENT.search(html, pos)) is not None and m.start() not in self.dead:
            if m[0] == ">":
                return m.start()
            opened.append(m.start())
            end = html.find(m[0], m.end())
            if end < 0:
                break
            pos = end + 1
        self.dead.update(opened)
        return html.find(">", at)


def parse(html: str) -> Tree:
    t = Tree()
    o, ends, at, n = _Open(t), _Ends(html), 0, len(html)

    def text(upto: int) -> None:
        if upto > at:
            x = unescape(html[at:upto])
            t.parts.append((o.running() if not x.isspace() else o.stack[-1], x))

    while at < n:
        start = html.find("<", at)
        while start >= 0 and not (html[start + 1 : start + 2] in ("!", "?", "/") or _NAME.match(html, start + 1)):
            start = html.find("<", start + 1)
        if start < 0:
            text(n)
            break
        if html.startswith("<!--", start):
            text(start)
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        closing = html[start + 1] == "/"
        name = _NAME.match(html, start + 1 + closing)
        end = ends(name.end()) if name else html.find(">", start)
        if end < 0:  # no tag ends any more: what is left is text
            text(n)
            break
        text(start)
        at = end + 1
        if name is None:  # declaration
            continue
        attrs, name = html[name.end() : end], name[0].lower()
        if closing:
            if name not in INLINE:
                o.block()
            if o.where.get(name):
                o.cut(o.where[name][-1])
            continue
        if name in INLINE:
            o.running()
        elif name not in VOID:
            o.block()
        else:
            t.parts.append((-1, ""))
        if name in _ENDS_P:
            o.close(frozenset(["p"]), _P_STOPS)
        rule = _CLOSES.get(name)
        if rule:
            o.close(*rule)
        elif name not in _IN_HEAD and o.top == "head":
            o.cut(len(o.stack) - 1)
        if name in VOID:
            if name == "hr" and o.top == TEXT:
                o.cut(len(o.stack) - 1)
            continue
        if name in RAW:
            me = o.push(name, attrs, stays=False)
            close = re.compile(f"</{name}(?=[\\s/>])", re.IGNORECASE).search(html, at)
            body = html[at : close.start() if close else n]
            t.parts.append((me, unescape(body) if name in ("title", "textarea") else body))
            t.parts.append((-1, ""))
            at = close.end() if close else n
            at = (html.find(">", at) + 1 or n) if close else n
        else:  # <div/>: HTML ignores the slash; foreign markup and careless pages mean an empty element
            o.push(name, attrs, stays=not attrs.endswith("/") or name in _ENDS_P)
    return t
