"""A small HTML tree: parsing, selectors, serialising. For use inside Python operators, one page at a time.

The parser follows the HTML standard where books need it: raw-text and void
elements, implied html, head and body, optional end tags, formatting elements
that are reopened or adopted, implied table parts. It has no scripts, frames,
quirks mode or foster parenting. As in HTML, `<x/>` opens x unless x is void.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

# Fixed values of the HTML standard.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
FORMATTING = ("a", "b", "big", "code", "em", "font", "i", "nobr", "s", "small", "strike", "strong", "tt", "u")
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hgroup hr li dd dt main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = CLOSES_P | VOID | RAW | frozenset("html head body applet button caption colgroup marquee object select tbody td template tfoot th thead tr".split())
SCOPE = frozenset("applet caption html table td th marquee object template".split())
IN_HEAD = frozenset("base basefont bgsound link meta title style script noscript template".split())

TAG = re.compile(r"""<!--(.*?)(?:--!?>|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@dataclass(eq=False)
class Text:
    text: str
    parent: Element | None = None


@dataclass(eq=False)
class Comment:
    text: str
    parent: Element | None = None


@dataclass(eq=False)
class Element:
    name: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Element | None = None

    def append(self, node) -> None:
        if node.parent is not None:
            node.parent.children.remove(node)
        node.parent = self
        if isinstance(node, Text) and self.children and isinstance(self.children[-1], Text):
            self.children[-1].text += node.text
        else:
            self.children.append(node)

    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def walk(self) -> Iterator[Element]:
        """Itself and its descendants, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.elements()))

    def ancestors(self) -> Iterator[Element]:
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Text):
                out.append(node.text)
            elif isinstance(node, Element):
                todo.extend(reversed(node.children))
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c.text for c in self.children if isinstance(c, Text))

    def replace_child(self, old, new: list) -> None:
        at = next(i for i, c in enumerate(self.children) if c is old)
        for n in new:
            n.parent = self
        self.children[at : at + 1] = new


def parse(page: str) -> Element:
    """The html element of a page."""
    return _Builder().run(page)


def fragment(text: str) -> list:
    """Nodes of a piece of a page's body."""
    body = next(e for e in parse("<body>" + text).elements() if e.name == "body")
    nodes, body.children = body.children, []
    for n in nodes:
        n.parent = None
    return nodes


class _Builder:
    def __init__(self) -> None:
        self.root = Element("html")
        self.head: Element | None = None
        self.body: Element | None = None
        self.open = [self.root]
        self.active: list[Element | None] = []

    def run(self, page: str) -> Element:
        at, n = 0, len(page)
        while at < n:
            m = TAG.search(page, at)
            if m is None:
                self.text(page[at:])
                break
            if m.start() > at:
                self.text(page[at : m.start()])
            at = m.end()
            if m[3]:
                name = m[3].lower()
                if m[2]:
                    self.end(name)
                else:
                    attributes: dict[str, str] = {}
                    for key, a, b, c in ATTRIBUTE.findall(m[4]):
                        attributes.setdefault(key.lower(), html.unescape(a or b or c))
                    self.start(name, attributes)
                    if name in RAW:
                        stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                        raw = page[at : stop.start() if stop else n]
                        if raw:
                            self.open[-1].append(Text(html.unescape(raw) if name in ("title", "textarea") else raw))
                        self.open.pop()
                        at = stop.end() if stop else n
            elif m[1] is not None:
                (self.open[-1] if self.body or self.head else self.root).append(Comment(m[1]))
        self.ensure_body()
        return self.root

    def ensure_body(self) -> None:
        if self.head is None:
            self.head = Element("head")
            self.root.append(self.head)
        if self.body is None:
            del self.open[1:]
            self.body = Element("body")
            self.root.append(self.body)
            self.open.append(self.body)

    def insert(self, name: str, attributes: dict[str, str]) -> Element:
        node = Element(name, dict(attributes))
        self.open[-1].append(node)
        self.open.append(node)
        return node

    def text(self, raw: str) -> None:
        text = html.unescape(raw).replace("\r\n", "\n").replace("\r", "\n")
        if self.body is None:
            if not text.strip(" \t\n\f"):
                return
            self.ensure_body()
        if text.strip():
            self.reopen()
        elif self.active and self.active[-1] is not None and self.active[-1] not in self.open and self.open[-1].name not in ("table", "tbody", "tr", "ul", "ol"):
            self.reopen()
        self.open[-1].append(Text(text))

    def in_scope(self, names: frozenset | set, stops: frozenset = SCOPE) -> bool:
        for node in reversed(self.open):
            if node.name in names:
                return True
            if node.name in stops:
                return False
        return False

    def pop_to(self, names: frozenset | set) -> None:
        while len(self.open) > 2:
            if self.open.pop().name in names:
                return

    def close_p(self) -> None:
        if self.in_scope({"p"}, SCOPE | {"button"}):
            self.pop_to({"p"})

    def reopen(self) -> None:
        """Formatting elements that a block has cut off go on inside it."""
        at = len(self.active)
        while at and self.active[at - 1] is not None and self.active[at - 1] not in self.open:
            at -= 1
        for i in range(at, len(self.active)):
            old = self.active[i]
            self.active[i] = self.insert(old.name, old.attributes)

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name == "html":
            for k, v in attributes.items():
                self.root.attributes.setdefault(k, v)
            return
        if name == "head":
            if self.head is None and self.body is None:
                self.head = self.insert("head", attributes)
            return
        if name == "body":
            if self.body is None:
                self.ensure_body()
                self.body.attributes.update(attributes)
            else:
                for k, v in attributes.items():
                    self.body.attributes.setdefault(k, v)
            return
        if self.body is None:
            if name in IN_HEAD:
                if self.head is None:
                    self.head = self.insert("head", {})
                if self.open[-1] is self.root:
                    self.open.append(self.head)
                node = self.insert(name, attributes)
                if name in VOID:
                    self.open.remove(node)
                return
            self.ensure_body()
        if name in CLOSES_P:
            self.close_p()
        if name in HEADINGS and self.open[-1].name in HEADINGS:
            self.open.pop()
        if name in ("li", "dd", "dt"):
            same = {"li"} if name == "li" else {"dd", "dt"}
            for node in reversed(self.open):
                if node.name in same:
                    self.pop_to({node.name})
                    break
                if node.name in SPECIAL - {"address", "div", "p"}:
                    break
            self.close_p()
        if name in ("caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th", "col"):
            self.table_part(name)
        if name == "option" and self.open[-1].name == "option":
            self.open.pop()
        if name == "a" and any(e is not None and e.name == "a" for e in self.since_marker()):
            self.adopt("a")
            for e in [e for e in self.since_marker() if e.name == "a"]:
                self.active.remove(e)
                if e in self.open:
                    self.open.remove(e)
        if name in FORMATTING:
            self.reopen()
            node = self.insert(name, attributes)
            same = [e for e in self.since_marker() if e.name == name and e.attributes == attributes]
            if len(same) >= 3:
                self.active.remove(same[0])
            self.active.append(node)
            return
        if name not in CLOSES_P and name not in ("caption", "colgroup", "thead", "tbody", "tfoot", "tr", "td", "th", "col"):
            self.reopen()
        if name in ("td", "th", "caption", "applet", "marquee", "object"):
            self.active.append(None)
        node = self.insert(name, attributes)
        if name in VOID:
            self.open.remove(node)

    def since_marker(self) -> list[Element]:
        at = max((i + 1 for i, e in enumerate(self.active) if e is None), default=0)
        return self.active[at:]

    def table_part(self, name: str) -> None:
        tops = {"table"}
        if not self.in_scope(tops, frozenset({"html"})):
            return
        keep = {"td": {"tr"}, "th": {"tr"}, "tr": {"tbody", "thead", "tfoot"}}.get(name, tops)
        while len(self.open) > 2 and self.open[-1].name not in keep | tops:
            if self.open.pop().name in ("td", "th", "caption"):
                self.clear_marker()
        if name in ("td", "th") and self.open[-1].name == "table":
            self.insert("tbody", {})
        if name == "tr" and self.open[-1].name == "table":
            self.insert("tbody", {})
        if name in ("td", "th") and self.open[-1].name != "tr":
            self.insert("tr", {})

    def clear_marker(self) -> None:
        while self.active:
            if self.active.pop() is None:
                return

    def end(self, name: str) -> None:
        if name in ("html", "body"):
            return
        if name == "head":
            if self.body is None and self.head in self.open:
                del self.open[1:]
            return
        if self.body is None:
            if name in ("p", "br"):
                self.ensure_body()
            else:
                return
        if name == "p":
            if not self.in_scope({"p"}, SCOPE | {"button"}):
                self.insert("p", {})
            self.pop_to({"p"})
        elif name == "br":
            self.start("br", {})
        elif name in HEADINGS:
            if self.in_scope(HEADINGS):
                self.pop_to(HEADINGS)
        elif name in FORMATTING:
            self.adopt(name)
        elif name in ("td", "th", "caption", "applet", "marquee", "object"):
            if self.in_scope({name}, frozenset({"table", "html"})):
                self.pop_to({name})
                self.clear_marker()
        elif name in ("table", "tbody", "thead", "tfoot", "tr"):
            if any(e.name == name for e in self.open):
                while len(self.open) > 2:
                    popped = self.open.pop().name
                    if popped in ("td", "th", "caption"):
                        self.clear_marker()
                    if popped == name:
                        break
        else:
            for node in reversed(self.open[2:]):
                if node.name == name:
                    self.pop_to({name})
                    break
                if node.name in SPECIAL and name not in SPECIAL:
                    break
                if node.name in SCOPE:
                    break

    def adopt(self, name: str) -> None:
        """The standard's adoption agency: a formatting element that ends inside a block is divided around it."""
        if self.open[-1].name == name and self.open[-1] not in self.active:
            self.open.pop()
            return
        for _ in range(8):
            formatting = next((e for e in reversed(self.since_marker()) if e.name == name), None)
            if formatting is None:
                if any(e.name == name for e in self.open[2:]) and name not in FORMATTING:
                    self.pop_to({name})
                return
            if formatting not in self.open:
                self.active.remove(formatting)
                return
            at = self.open.index(formatting)
            furthest = next((e for e in self.open[at + 1 :] if e.name in SPECIAL), None)
            if furthest is None:
                del self.open[at:]
                self.active.remove(formatting)
                return
            common = self.open[at - 1]
            mark = self.active.index(formatting)
            node_at = self.open.index(furthest)
            last = furthest
            inner = 0
            while True:
                inner += 1
                node_at -= 1
                node = self.open[node_at]
                if node is formatting:
                    break
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    del self.open[node_at]
                    continue
                copy = Element(node.name, dict(node.attributes))
                self.active[self.active.index(node)] = copy
                self.open[node_at] = copy
                if last is furthest:
                    mark = self.active.index(copy) + 1
                copy.append(last)
                last = copy
            common.append(last)
            copy = Element(formatting.name, dict(formatting.attributes))
            for child in list(furthest.children):
                copy.append(child)
            furthest.append(copy)
            if self.active.index(formatting) < mark:
                mark -= 1
            self.active.remove(formatting)
            self.active.insert(mark, copy)
            self.open.remove(formatting)
            self.open.insert(self.open.index(furthest) + 1, copy)


def escaped(text: str, attribute: bool = False) -> str:
    text = text.replace("&", "&amp;").replace(" ", "&nbsp;")
    return text.replace('"', "&quot;") if attribute else text.replace("<", "&lt;").replace(">", "&gt;")


def to_html(node) -> str:
    """The node as HTML."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, Text):
            raw = x.parent is not None and x.parent.name in RAW - {"title", "textarea"}
            out.append(x.text if raw else escaped(x.text))
        elif isinstance(x, Comment):
            out.append(f"<!--{x.text}-->")
        else:
            out.append(f"<{x.name}" + "".join(f' {k}="{escaped(v, True)}"' for k, v in x.attributes.items()) + ">")
            if x.name not in VOID:
                todo.append(f"</{x.name}>")
                todo.extend(reversed(x.children))
    return "".join(out)


def inner_html(node: Element) -> str:
    return "".join(to_html(c) for c in node.children)


def to_xhtml(node) -> str:
    """The node as XML: every element has an end tag, only & < > (and quotes in attributes) are references."""
    xml = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out: list[str] = []
    todo: list = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, Text):
            out.append(xml(x.text))
        elif isinstance(x, Comment):
            out.append(f"<!--{x.text}-->")
        else:
            out.append(f"<{x.name}" + "".join(f' {k}="{xml(v).replace(chr(34), "&quot;")}"' for k, v in x.attributes.items()) + ">")
            todo.append(f"</{x.name}>")
            todo.extend(reversed(x.children))
    return "".join(out)


_SIMPLE = re.compile(r"""(\*|[\w-]+)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\s\]]+))\s*)?\]|:not\(([^()]+)\)|:(first-child|last-child|only-child|empty)""", re.X)


def _compound(text: str) -> Callable[[Element], bool]:
    tests: list[Callable[[Element], bool]] = []
    at = 0
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or not m[0]:
            raise ValueError(f"selector not understood: {text!r}")
        at = m.end()
        tag, ident, cls, key, op, a, b, c, negated, pseudo = m.groups()
        if tag:
            tests.append(lambda e, t=tag.lower(): t == "*" or e.name == t)
        elif ident:
            tests.append(lambda e, t=ident: e.attributes.get("id") == t)
        elif cls:
            tests.append(lambda e, t=cls: t in e.attributes.get("class", "").split())
        elif key:
            value = next((x for x in (a, b, c) if x is not None), "")
            compare = {
                None: lambda v, w: True, "=": lambda v, w: v == w, "~=": lambda v, w: w in v.split(), "|=": lambda v, w: v == w or v.startswith(w + "-"),
                "^=": lambda v, w: bool(w) and v.startswith(w), "$=": lambda v, w: bool(w) and v.endswith(w), "*=": lambda v, w: bool(w) and w in v,
            }[op]
            tests.append(lambda e, k=key.lower(), w=value, f=compare: k in e.attributes and f(e.attributes[k], w))
        elif negated:
            inner = selector(negated)
            tests.append(lambda e, f=inner: not f(e))
        else:
            place = {
                "first-child": lambda e: e.parent is not None and e.parent.elements()[0] is e,
                "last-child": lambda e: e.parent is not None and e.parent.elements()[-1] is e,
                "only-child": lambda e: e.parent is not None and len(e.parent.elements()) == 1,
                "empty": lambda e: not e.children,
            }
            tests.append(place[pseudo])
    return lambda e: all(t(e) for t in tests)


def selector(text: str) -> Callable[[Element], bool]:
    """A test of elements from a CSS selector list; raises ValueError for what isn't one."""
    choices = []
    for one in re.split(r",(?![^\[(]*[\])])", text):
        parts = re.findall(r"\s*([>+~])\s*|(\s+)|((?:\[[^\]]*\]|\([^)]*\)|[^\s>+~\[(])+)", one.strip())
        steps: list[tuple[str, Callable[[Element], bool]]] = []
        relation = " "
        for symbol, space, compound in parts:
            if compound:
                steps.append((relation, _compound(compound)))
                relation = " "
            elif symbol:
                relation = symbol
            elif space and relation == " ":
                relation = " "
        if not steps:
            raise ValueError(f"selector not understood: {text!r}")
        choices.append(steps)

    def holds(e: Element, steps: list) -> bool:
        relation, test = steps[-1]
        if not test(e):
            return False
        if len(steps) == 1:
            return True
        rest = steps[:-1]
        if relation == ">":
            return e.parent is not None and holds(e.parent, rest)
        if relation in "+~":
            kin = e.parent.elements() if e.parent is not None else []
            before = kin[: next((i for i, k in enumerate(kin) if k is e), 0)]
            return any(holds(k, rest) for k in (before[-1:] if relation == "+" else before))
        return any(holds(a, rest) for a in e.ancestors())

    return lambda e: any(holds(e, steps) for steps in choices)
