"""Web and book pages as rows of text units, and translations back into pages.

A page is a tree, so these operators run Python per page, in Arrow batches of
pages; only flat rows leave them. Everything else about the rows (keys, flags,
packing, joins) is in columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.tokens import ANY_TOKEN, is_valid_of, normalize_tokens_of
from . import dom
from .dom import Element, Text

# What a unit of text is made of.
PRIORITY = "p, pre, h1, h2, h3, h4, h5, h6, blockquote"
BLOCKS = frozenset(
    "address blockquote dialog div figure figcaption footer header legend li main p pre search article aside h1 h2 h3 h4 h5 h6 hgroup nav"
    " section dd dl dt menu ol ul table caption colgroup col thead tbody tfoot tr td th".split()
)
OPAQUE = frozenset("img br hr code math svg script style".split())
NEVER = frozenset("script style svg math".split())
GROUPED = frozenset("li th td caption".split())

_NOISE = re.compile(r"""[-\d\s.'\\"‘’“”,=~!@#$%^&º*|≈<>?/`—…+:–_(){}\[\]]+""")
_LINK = re.compile(r"(?:https?://|www\.)\S+", re.I)
_ISBN = re.compile(r"ISBN(?:-1[03])?\s*:?\s*[0-9X][0-9X\-\s]{8,}", re.I)
_LABEL = re.compile(r"(?:Figure|Fig\.?|Table)\s*[:#.]?\s*[A-Z0-9]+(?:[.\-][A-Z0-9]+)*[.:]?", re.I)
_NUMBER = re.compile(r"[\d,.\-+eE\s%]+")


def normalized(text: str) -> str:
    if not text.isascii():
        text = text.replace("\u200b", "").replace("\ufeff", "")
    return " ".join(text.split())


def non_translatable(text: str) -> bool:
    v = text.strip()
    return not v or any(p.fullmatch(v) for p in (_LINK, _ISBN, _LABEL)) or bool(re.search("[0-9]", v) and _NUMBER.fullmatch(v))


@dataclass(frozen=True)
class Rules:
    """What becomes a unit, what is kept as it is, and what isn't translated. Selectors are CSS."""

    priority: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    reserve: tuple[str, ...] = ()
    exclude_tags: str = "sup,code,pre"
    translate_tags: str = ""
    filters: tuple[str, ...] = ()
    mode: str = "normal"
    scope: str = "text"

    def compiled(self) -> _Compiled:
        return _Compiled(self)


class _Compiled:
    def __init__(self, rules: Rules):
        split = lambda text: [x for x in (p.strip().lower() for p in text.split(",")) if x]
        self.priority = [dom.selector(s) for s in (PRIORITY, *rules.priority)]
        self.ignore = [dom.selector(s) for s in rules.ignore]
        self.reserve = [dom.selector(s) for s in rules.reserve]
        self.exclude = [dom.selector(s) for s in split(rules.exclude_tags)]
        self.tags = set(split(rules.translate_tags))
        how = {"normal": lambda r: re.compile(re.escape(r), re.I), "case": lambda r: re.compile(re.escape(r)), "regex": re.compile}[rules.mode]
        self.filters = [how(r) for r in rules.filters]
        self.html = rules.scope == "html"

    def is_priority(self, e: Element) -> bool:
        return any(m(e) for m in self.priority)

    def is_ignored(self, e: Element) -> bool:
        return any(m(e) for m in (*self.ignore, *self.exclude))

    def is_reserved(self, e: Element) -> bool:
        return any(m(e) for m in self.reserve) or self.is_ignored(e)

    def is_filtered(self, visible: str, raw: str) -> bool:
        """Of an element's normalised text and its HTML."""
        where = [visible, raw] if self.html else [visible]
        return any(_NOISE.fullmatch(w) or any(f.search(w) for f in self.filters) for w in where)


def candidates(root: Element, rules: _Compiled) -> list[tuple[Element, bool]]:
    """(element, ignored) of the units below root, in document order; text right under root is in none."""
    out: list[tuple[Element, bool]] = []
    todo = list(reversed(root.elements()))
    while todo:
        e = todo.pop()
        if e.name in NEVER:
            continue
        if rules.is_ignored(e):
            if normalized(e.text()):
                out.append((e, True))
        elif rules.tags and e.name not in rules.tags:
            todo.extend(reversed(e.elements()))
        elif rules.is_priority(e) or not any(c.name in BLOCKS for c in e.elements()) or normalized(e.own_text()):
            out.append((e, False))
        else:
            todo.extend(reversed(e.elements()))
    return out


def _parts(e: Element, rules: _Compiled, keep_ids: bool) -> Iterator[tuple[str | None, str]]:
    """(token, literal) of what is inside the element; text has no token. Numbers go by document order."""
    n = 0
    todo: list = list(reversed(e.children))
    while todo:
        x = todo.pop()
        if isinstance(x, tuple):
            yield x
        elif isinstance(x, Text):
            yield None, x.text
        elif isinstance(x, Element) and x.name not in OPAQUE and not rules.is_reserved(x):
            yield f"{{{{etm_o_{n:05}}}}}", start_tag(x, keep_ids)
            todo.append((f"{{{{etm_c_{n:05}}}}}", f"</{x.name}>"))
            todo.extend(reversed(x.children))
            n += 1
        else:
            yield f"{{{{etm_n_{n:05}}}}}", dom.to_html(x) if keep_ids or not isinstance(x, Element) else _without_ids(x)
            n += 1


def tokenize(e: Element, rules: _Compiled) -> str:
    """The element's text with its inner markup as tokens."""
    return normalized("".join(token or text for token, text in _parts(e, rules, True)))


def _without_ids(e: Element) -> str:
    kept = [(x, x.attributes.pop("id")) for x in e.walk() if "id" in x.attributes]
    text = dom.to_html(e)
    for x, value in kept:
        x.attributes["id"] = value
    return text


def _attribute(text: str) -> str:
    return text.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")


def _text(text: str) -> str:
    return re.sub("\r\n|\r|\n", "<br>", text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def joined_style(*parts: str) -> str:
    out = ""
    for part in (p for p in parts if p.strip()):
        out = out + (";" if out.strip() and not out.rstrip().endswith(";") else "") + (part if not out else part.strip())
    return out


def start_tag(e: Element, keep_id: bool, cls: str = "", style: str = "", lang: str | None = None, direction: str | None = None, translated: bool = False) -> str:
    """The element's start tag; for a translation with its class and style added and its language in place of the old one."""
    gone = {"class", "style"} | ({"id"} if not keep_id else set()) | ({"lang", "dir"} if translated else set())
    pairs = [(k, v) for k, v in e.attributes.items() if k not in gone]
    classes = e.attributes.get("class", "")
    if cls and cls not in classes.split():
        classes = f"{classes} {cls}" if classes else cls
    pairs += [("class", classes), ("style", joined_style(e.attributes.get("style", ""), style)), ("lang", lang or ""), ("dir", direction or "")]
    always = len(pairs) - 4
    return f"<{e.name}" + "".join(f' {k}="{_attribute(v)}"' for i, (k, v) in enumerate(pairs) if v or i < always) + ">"


@dataclass(frozen=True)
class Look:
    """How a translation is placed and styled."""

    position: str = "below"
    style: str = ""
    color: str = ""
    original_color: str = ""
    lang: str | None = None
    direction: str | None = None
    gap_kind: str = "percentage"
    gap_percentage: int = 10
    gap_spaces: int = 6

    def span(self, inner: str) -> str:
        pairs = [("class", "et-translation"), ("lang", self.lang or ""), ("dir", self.direction or ""), ("style", self.own_style())]
        return "<span" + "".join(f' {k}="{_attribute(v)}"' for k, v in pairs if v) + f">{inner}</span>"

    def own_style(self, *before: str) -> str:
        return joined_style(*before, f"color:{self.color}" if self.color else "", self.style)

    def element(self, e: Element, inner: str, keep_id: bool, block: bool) -> str:
        style = self.own_style("display:block" if block else "")
        return start_tag(e, keep_id, "et-translation", style, self.lang, self.direction, True) + f"{inner}</{e.name}>"

    def table(self, original: str, translated: str) -> str:
        left, right = (translated, original) if self.position == "left" else (original, translated)
        if self.gap_kind == "space_count":
            side, middle, gap = "50%", "", "&nbsp;" * self.gap_spaces
        else:
            side, middle, gap = f"{(max(100 - self.gap_percentage, 0) + 1) // 2}%", f' width="{self.gap_percentage}%"', ""
        cell = lambda x: f'<td width="{side}" valign="top">{x}</td>'
        return f'<table class="et-translation-table" width="100%"><tbody><tr>{cell(left)}<td{middle}>{gap}</td>{cell(right)}</tr></tbody></table>'


BREAK = re.compile(r"<br\s*/?>", re.I)


def balanced(markup: str) -> bool:
    """Every element that a piece of markup opens, it closes."""
    open_: list[str] = []
    for closing, name, rest in re.findall(r"(?s)<\s*(/?)\s*([A-Za-z][\w:-]*)\b([^>]*)>", markup):
        name = name.lower()
        if closing:
            if not open_ or open_.pop() != name:
                return False
        elif not rest.rstrip().endswith("/") and name not in ("br", "hr", "img", "input", "meta", "link"):
            open_.append(name)
    return not open_


def interleaved(e: Element, restored: str, look: Look) -> str | None:
    """Line by line, where both have the same number of lines and no markup runs over a break."""
    old, new = BREAK.split(dom.inner_html(e)), BREAK.split(restored)
    if len(old) < 2 or len(old) != len(new) or not all(map(balanced, new)):
        return None
    lines = []
    for o, t in zip(old, new, strict=True):
        said = [look.span(t)] if t.strip() else []
        lines.append("<br>".join([*said, o] if look.position == "above" else [o, *said]))
    return "<br>".join(lines)


def restore_markup(e: Element, translated: str, rules: _Compiled, keep_ids: bool) -> str:
    """The translation with the element's own markup for its tokens; raises where it hasn't the same tokens."""
    literal = {token: text for token, text in _parts(e, rules, keep_ids) if token}
    said = normalize_tokens_of(translated)
    if not is_valid_of(tokenize(e, rules), said):
        raise ValueError("the translation broke the markup tokens")
    found = re.findall(ANY_TOKEN, said)
    texts = [_text(t) for t in re.split(ANY_TOKEN, said)]
    return "".join(t + literal[k] for t, k in zip(texts, found, strict=False)) + texts[-1]


def place(e: Element, restored: str, look: Look) -> None:
    """Puts a restored translation into the tree."""
    if look.position == "only":
        e.parent.replace_child(e, dom.fragment(look.element(e, restored, True, False)))
        return
    if look.original_color:
        for x in e.walk():
            x.attributes["style"] = joined_style(x.attributes.get("style", ""), f"color:{look.original_color}")
    if look.position in ("above", "below") and (lines := interleaved(e, restored, look)) is not None:
        e.children = []
        for n in dom.fragment(lines):
            e.append(n)
        return
    if e.name in GROUPED or e.parent.name not in BLOCKS | {"html", "body"}:
        span = look.span(restored)
        piece = {"above": f"{span}<br>", "left": f"{span}&nbsp;", "below": f"<br>{span}"}.get(look.position, f"&nbsp;{span}")
        nodes = dom.fragment(piece)
        for n in nodes:
            n.parent = e
        e.children = nodes + e.children if look.position in ("above", "left") else e.children + nodes
        return
    said = look.element(e, restored, False, True)
    if look.position in ("above", "below"):
        nodes = dom.fragment(said)
        e.parent.replace_child(e, [*nodes, e] if look.position == "above" else [e, *nodes])
    else:
        e.parent.replace_child(e, dom.fragment(look.table(dom.to_html(e), said)))


def decode_page(data: bytes) -> str:
    """UTF-16 by its mark, else UTF-8 with or without one; raises for anything else, whatever the page declares."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data[2:].decode("utf-16-le" if data[:1] == b"\xff" else "utf-16-be")
    return data.removeprefix(b"\xef\xbb\xbf").decode()


def doctype_range(text: str) -> tuple[int, int] | None:
    """Where the document type stands: to the ">" outside of quotes and brackets."""
    start = text.lower().find("<!doctype")
    if start < 0:
        return None
    depth, quote = 0, ""
    for i in range(start, len(text)):
        ch = text[i]
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"":
            quote = ch
        elif ch == "[":
            depth += 1
        elif ch == "]":
            depth = max(0, depth - 1)
        elif ch == ">" and not depth:
            return start, i + 1
    return start, len(text)


def _tree(page: str) -> Element:
    at = doctype_range(page)
    return dom.parse(page if at is None else page[: at[0]] + page[at[1] :])


def body_of(tree: Element) -> Element:
    return next(e for e in tree.elements() if e.name == "body")


def serialized(tree: Element, page: str) -> str:
    """The tree as an XHTML file with the page's document type; raises if that isn't well-formed."""
    at = doctype_range(page)
    body = dom.to_xhtml(tree)
    try:
        expat.ParserCreate().Parse(body.encode(), True)
    except expat.ExpatError as e:
        raise ValueError(f"the page can't be written as XHTML: {e}") from e
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + (page[at[0] : at[1]] + "\n" if at else "") + body


def body_units(page: str, rules: _Compiled) -> Iterator[tuple[int, str, str, bool]]:
    """(key, raw, original, ignored) of a page's units; key counts candidates, those without text too."""
    body = body_of(_tree(page))
    if rules.is_ignored(body):
        return
    for key, (e, ignored) in enumerate(candidates(body, rules)):
        visible = normalized(e.text())
        original = tokenize(e, rules) if visible else ""
        if original:
            raw = dom.to_html(e)
            yield key, raw, original, ignored or rules.is_filtered(visible, raw) or non_translatable(visible)


_NAV = dom.selector("nav a, nav span")


def nav_nodes(tree: Element) -> list[Element]:
    """Links and spans of a table of contents that aren't inside another link or span."""
    return [e for e in tree.walk() if _NAV(e) and not any(a.name in ("a", "span") for a in e.ancestors())]


def nav_units(page: str) -> Iterator[tuple[int, str, str]]:
    """(key, raw, original) of the entries of a table of contents; key counts those without text too."""
    for k, e in enumerate(nav_nodes(_tree(page))):
        if text := normalized(e.text()):
            yield k, dom.to_html(e), text


def inject_body(page: str, resource: str, translations: dict[str, str], rules: _Compiled, look: Look) -> tuple[str, int]:
    """The page with its translations, and how many; the page as it is where there are none."""
    tree = _tree(page)
    body, n = body_of(tree), 0
    if not rules.is_ignored(body):
        for key, (e, _) in enumerate(candidates(body, rules)):
            said = translations.get(keys.uid_of("body", resource, key))
            if said is not None:
                if not said.strip():
                    raise ValueError(f"an empty translation can't be written: {resource} {key}")
                place(e, restore_markup(e, said, rules, look.position == "only"), look)
                n += 1
    return (serialized(tree, page), n) if n else (page, 0)


def inject_nav(page: str, resource: str, translations: dict[str, str], position: str) -> tuple[str, int]:
    tree, n = _tree(page), 0
    for key, e in enumerate(nav_nodes(tree)):
        said = translations.get(keys.uid_of("toc", resource, key))
        if said is not None:
            old, e.children = normalized(e.text()), []
            e.append(Text(combined(old, said, position)))
            n += 1
    return (serialized(tree, page), n) if n else (page, 0)


def combined(original: str, translation: str, position: str) -> str:
    o, t = original.strip(), translation.strip()
    return t if position == "only" else f"{t} {o}" if position in ("above", "left") else f"{o} {t}"


UNIT = "book string, page string, kind string, key string, raw string, original string, ignored boolean"


def extract_pages(pages: DataFrame, rules: Rules = Rules(), kind: str = "body") -> DataFrame:
    """pages(book, page, html) as elements, one row a unit of text (kind body) or an entry of contents (kind toc). Filter pages before: each is parsed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = rules.compiled()
        for pdf in frames:
            out = []
            for book, page, text in zip(pdf["book"], pdf["page"], pdf["html"], strict=True):
                if not isinstance(text, str):
                    continue
                if kind == "body":
                    out += [(book, page, kind, str(k), raw, original, ignored) for k, raw, original, ignored in body_units(text, compiled)]
                else:
                    out += [(book, page, kind, str(k), raw, t, False) for k, raw, t in nav_units(text)]
            yield pd.DataFrame(out, columns=["book", "page", "kind", "key", "raw", "original", "ignored"])

    return pages.select("book", "page", "html").mapInPandas(run, UNIT)


def keyed_elements(units: DataFrame) -> DataFrame:
    """Units with id and signature."""
    return units.withColumn("id", keys.uid(F.col("kind"), F.col("page"), F.col("key"))).withColumn("signature", keys.signature(F.col("kind"), F.col("page"), F.col("key"), F.col("raw"), F.col("original")))


def inject_pages(pages: DataFrame, translations: DataFrame, rules: Rules = Rules(), look: Look = Look()) -> DataFrame:
    """pages(book, page, html) with translations(book, page, id, translation) put in: (book, page, html, injected).

    Translations are gathered by page - a page is one task's work anyway - and pages without any pass by.
    """
    said = translations.filter(F.col("translation").isNotNull()).groupBy("book", "page").agg(F.map_from_entries(F.collect_list(F.struct("id", "translation"))).alias("said"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = rules.compiled()
        for pdf in frames:
            out = [inject_body(text, page, dict(said), compiled, look) if said and isinstance(text, str) else (text, 0) for page, text, said in zip(pdf["page"], pdf["html"], pdf["said"], strict=True)]
            yield pd.DataFrame({"book": pdf["book"], "page": pdf["page"], "html": [o[0] for o in out], "injected": [o[1] for o in out]})

    return pages.join(said, ["book", "page"], "left").select("book", "page", "html", "said").mapInPandas(run, "book string, page string, html string, injected int")
