"""Book packages: manifest, spine, metadata, contents, and what order their files are read in.

The XML of a package is small and read per book inside Python operators; the
relations between its rows (spine and manifest, items and archive members) are
joins.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, names
from .markup import combined, decode_page, normalized

# The metadata that holds text, and the limits of an archive.
METADATA = ("title", "creator", "publisher", "rights", "subject", "contributor", "description")
MEMBER_BYTES, TOTAL_BYTES, RATIO, RATIO_FROM = 256 << 20, 4 << 30, 1000, 10 << 20
NCX = "application/x-dtbncx+xml"

_XML = re.compile(r"""<!--.*?-->|<!\[CDATA\[(.*?)\]\]>|<\?.*?\?>|<!(?:[^>\["']|"[^"]*"|'[^']*'|\[[^\]]*\])*>|<(/?)([^\s/>]+)((?:[^>"']|"[^"]*"|'[^']*')*?)(/?)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")


def xml_text(raw: str) -> str:
    """References of XML (and &nbsp;) decoded; others stay as they are."""
    known = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0"}
    return re.sub(r"&(#x?[0-9A-Fa-f]+|\w+);", lambda m: html.unescape(m[0]) if m[1][0] == "#" else known.get(m[1], m[0]), raw)


def events(xml: str) -> Iterator[tuple[str, str, dict[str, str] | str, int, int]]:
    """(kind, local name, attributes or text, from, to) of a document: start, end, empty and text."""
    at = 0
    for m in _XML.finditer(xml):
        if m.start() > at:
            yield "text", "", xml_text(xml[at : m.start()]), at, m.start()
        at = m.end()
        if m[1] is not None:
            yield "text", "", m[1], m.start(), m.end()
        elif m[3]:
            local = m[3].rpartition(":")[2]
            if m[2]:
                yield "end", local, {}, m.start(), m.end()
            else:
                attributes = {k.rpartition(":")[2]: xml_text(a or b) for k, a, b in _ATTRIBUTE.findall(m[4])}
                yield "empty" if m[5] else "start", local, attributes, m.start(), m.end()
    if at < len(xml):
        yield "text", "", xml_text(xml[at:]), at, len(xml)


@lru_cache(64)  # most books have the same one
def container_path(xml: str) -> str:
    """The package file that a container names first."""
    for kind, name, attributes, _, _ in events(xml):
        if kind in ("start", "empty") and name == "rootfile" and "full-path" in attributes:
            return unquote(attributes["full-path"]).replace("\\", "/")
    raise ValueError("the container names no package")


def package_of(xml: str) -> dict:
    """{items, idrefs, toc, title}: what a package file says; spine entries still by id."""
    items, idrefs, toc, title, inside = [], [], "", "", False
    for kind, name, value, _, _ in events(xml):
        if kind in ("start", "empty"):
            if name == "item":
                items.append((value.get("id", ""), value.get("href", ""), value.get("media-type", ""), value.get("properties", "").split()))
            elif name == "itemref" and "idref" in value:
                idrefs.append(value["idref"])
            elif name == "spine" and kind == "start":
                toc = value.get("toc", toc)
            elif name == "title" and kind == "start" and not title:
                inside = True
        elif kind == "text" and inside:
            title += value
        elif kind == "end" and name == "title":
            inside, title = False, normalized(title)
    return {"items": items, "idrefs": idrefs, "toc": toc, "title": title}


def _captures(xml: str, wanted, scope: str | None = None) -> Iterator[tuple[str, str, int, int]]:
    """(name, text, from, to) of the content of the elements wanted, outermost ones first; within `scope` elements if given."""
    name, depth, text, begin, inside = "", 0, "", 0, 0
    for kind, local, value, a, b in events(xml):
        if depth:
            if kind == "start":
                depth += 1
            elif kind == "end":
                depth -= 1
                if not depth:
                    yield name, text, begin, a
            elif kind == "text":
                text += value
            continue
        if scope and local == scope and kind in ("start", "end"):
            inside += 1 if kind == "start" else -1
        elif kind == "start" and wanted(local) and (not scope or inside):
            name, depth, text, begin = local, 1, "", b
    if depth:
        raise ValueError(f"<{name}> isn't closed")


def metadata_units(xml: str) -> Iterator[tuple[str, str, str]]:
    """(key, field, text): key numbers a field's elements, empty ones too; empty ones give no row."""
    seen: Counter = Counter()
    for name, text, _, _ in _captures(xml, lambda n: n.lower() in METADATA):
        field = name.lower()
        if normalized(text):
            yield f"{field}:{seen[field]}", field, normalized(text)
        seen[field] += 1


def ncx_units(xml: str) -> Iterator[tuple[str, str]]:
    """(key, label) of a table of contents; key counts labels with text."""
    labels = (normalized(t) for _, t, _, _ in _captures(xml, lambda n: n == "text", "navLabel"))
    for k, label in enumerate(x for x in labels if x):
        yield str(k), label


def _spliced(xml: str, changes: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, text in changes:
        out += [xml[at:a], text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")]
        at = b
    return "".join([*out, xml[at:]])


def rewrite_metadata(xml: str, resource: str, translations: dict[str, str], position: str, title: str) -> tuple[str, int]:
    """The package with translated metadata and the final title in its first title; only translations count."""
    seen: Counter = Counter()
    changes, n = [], 0
    for name, text, a, b in _captures(xml, lambda x: x.lower() in METADATA):
        field = name.lower()
        said = translations.get(keys.uid_of("metadata", resource, f"{field}:{seen[field]}"))
        n += said is not None
        if field == "title" and not seen[field]:
            changes.append((a, b, title))
        elif said is not None:
            changes.append((a, b, combined(normalized(text), said, position)))
        seen[field] += 1
    return _spliced(xml, changes), n


def rewrite_ncx(xml: str, resource: str, translations: dict[str, str], position: str) -> tuple[str, int]:
    changes, key = [], 0
    for _, text, a, b in _captures(xml, lambda x: x == "text", "navLabel"):
        if label := normalized(text):
            said = translations.get(keys.uid_of("toc", resource, key))
            key += 1
            if said is not None:
                changes.append((a, b, combined(label, said, position)))
    return _spliced(xml, changes), len(changes)


def package_rows(opfs: DataFrame) -> DataFrame:
    """opfs(book, path, content) as (book, path, title, toc, items, idrefs), one row a book."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            told = [package_of(decode_page(bytes(c))) for c in pdf["content"]]
            yield pd.DataFrame(
                {"book": pdf["book"], "path": pdf["path"], "title": [t["title"] for t in told], "toc": [t["toc"] for t in told],
                 "items": [[{"id": i, "href": h, "media_type": m, "properties": p} for i, h, m, p in t["items"]] for t in told], "idrefs": [t["idrefs"] for t in told]}
            )

    return opfs.select("book", "path", "content").mapInPandas(run, "book string, path string, title string, toc string, items array<struct<id:string,href:string,media_type:string,properties:array<string>>>, idrefs array<string>")


def manifest(packages: DataFrame) -> DataFrame:
    """(book, pos, id, href, media_type, properties)."""
    return packages.select("book", F.posexplode("items").alias("pos", "i")).select("book", "pos", "i.*")


def spine(packages: DataFrame) -> DataFrame:
    """(book, pos, idref)."""
    return packages.select("book", F.posexplode("idrefs").alias("pos", "idref"))


def spine_hrefs(spine_rows: DataFrame, items: DataFrame) -> DataFrame:
    """(book, pos, href): spine entries by their item's href; of items with one id the last counts, entries without an item go."""
    by_id = items.groupBy("book", "id").agg(F.max_by("href", "pos").alias("href"))
    return spine_rows.join(by_id, (spine_rows.book == by_id.book) & (spine_rows.idref == by_id.id)).select(spine_rows.book, "pos", "href")


def content_order(items: DataFrame, spine_rows: DataFrame, contents: Column) -> DataFrame:
    """(book, place, id, href, media_type) of the text files: those of the spine in its order, then the rest by href.

    `contents` tells the items that are tables of contents, which aren't text.
    A file that the spine names twice is read where it is named first, and of
    items with one href the first stands for it.
    """
    is_text = names.is_content(F.col("href"), F.col("media_type")) & ~F.coalesce(contents, F.lit(False))
    first = items.groupBy("book", "href").agg(F.min_by(F.struct("id", "media_type", is_text.alias("text")), "pos").alias("i")).filter("i.text").select("book", "href", "i.id", "i.media_type")
    in_spine = spine_hrefs(spine_rows, items).groupBy("book", "href").agg(F.min("pos").alias("at"))
    read = first.join(in_spine, ["book", "href"]).select("book", F.lit(0).alias("part"), "at", "id", "href", "media_type")
    rest = items.filter(is_text).join(read.select("book", "href"), ["book", "href"], "left_anti").select("book", F.lit(1).alias("part"), F.lit(0).alias("at"), "id", "href", "media_type")
    place = F.row_number().over(Window.partitionBy("book").orderBy("part", "at", "href", "id")) - 1
    return read.unionByName(rest).select("book", place.alias("place"), "id", "href", "media_type")


def archive_violations(members: DataFrame) -> DataFrame:
    """(book, name, violation) of members(book, idx, name, size, csize): a repeated name, a member or a whole too large, a suspicious ratio."""
    running = F.sum("size").over(Window.partitionBy("book").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(Window.partitionBy("book", "name").orderBy("idx"))
    checks = [
        (F.col("nth") > 1, "repeated name"),
        (F.col("size") > MEMBER_BYTES, "member too large"),
        (F.col("running") > TOTAL_BYTES, "archive too large"),
        ((F.col("size") > RATIO_FROM) & (F.col("csize") > 0) & (F.expr("size div csize") > RATIO), "suspicious ratio"),
    ]
    what = F.coalesce(*(F.when(test, F.lit(said)) for test, said in checks))
    return members.withColumn("running", running).withColumn("nth", nth).select("book", "idx", "name", what.alias("violation")).filter("violation is not null")


def violation_of(members: Iterable[tuple[str, int, int]]) -> tuple[str, str] | None:
    """(name, violation) of the first of an archive's members (name, size, csize) that breaks a limit, as of archive_violations."""
    seen: set[str] = set()
    running = 0
    for name, size, csize in members:
        running += size
        checks = ((name in seen, "repeated name"), (size > MEMBER_BYTES, "member too large"), (running > TOTAL_BYTES, "archive too large"), (size > RATIO_FROM and csize > 0 and size // csize > RATIO, "suspicious ratio"))
        for broken, said in checks:
            if broken:
                return name, said
        seen.add(name)
    return None


def missing_members(order: DataFrame, members: DataFrame) -> DataFrame:
    """Text files of the order whose archive lacks them: an error for the book."""
    return order.join(members.select("book", F.col("name").alias("resolved")), ["book", "resolved"], "left_anti")
