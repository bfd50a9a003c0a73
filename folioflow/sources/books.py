"""Books as tables: listing, reading the members of EPUB archives, and writing them back.

Readers take Spark's binaryFile source, so they reach whatever Spark reaches.
"""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import names
from ..operators import markup, packages

# Input formats by extension.
EXTENSIONS = "epub mobi azw3 azw fb2 pdf rtf txt docx html htm odt pdb cbz cbr".split()
NATIVE = "epub"

#: Bounds of what a task hands on at a time.
FRAME_BYTES, FRAME_ROWS = 16 << 20, 10_000

#: What files begin with that aren't whole yet.
HIDDEN = ".folioflow-"

MEMBER = "book string, idx int, name string, size long, csize long, content binary"


def list_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, extension, length) of the supported files in a folder, or of one file; hidden ones and sub-folders are passed over, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")
    name = names.base_name(F.col("path"))
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.withColumn("extension", extension).filter(extension.isin(EXTENSIONS) & ~F.startswith(name, F.lit("."))).select("path", "extension", "length").orderBy("path")


def read_members(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """One row for each file in each EPUB under the path."""
    return members_of(epub_files(spark, path), with_content)


def epub_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path).select("path", "content")


def members_of(files: DataFrame, with_content: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each file in each archive of files(path, content), in archive order, with the columns to keep of its archive. Each archive is read by one task."""

    def rows(book: str, data: bytes, *kept) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i, m in enumerate(z.infolist()):  # none over the limit is unpacked
                body = z.read(m) if with_content and m.file_size <= packages.MEMBER_BYTES else None
                yield book, i, m.filename, m.file_size, m.compress_size, body, *kept

    more = files.select(*keep).schema
    schema = T.StructType([*T._parse_datatype_string(MEMBER).fields, *more.fields])
    return _rows_of(files.select("path", "content", *keep), rows, schema)


def _rows_of(files: DataFrame, rows: Callable[..., Iterator[tuple]], schema: T.StructType) -> DataFrame:
    """What rows(*columns) gives for each row of the files, in batches of a bounded number of bytes (and one row at least)."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                for r in rows(*(c[i].as_py() for c in batch.columns)):
                    held.append(r)
                    size += sum(len(v) for v in r if isinstance(v, (bytes, str)))
                    if size >= FRAME_BYTES or len(held) >= FRAME_ROWS:
                        yield _batch(held, arrow)
                        held, size = [], 0
        if held:
            yield _batch(held, arrow)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def pack_members(members: DataFrame) -> DataFrame:
    """members(book, idx, name, content) as files(path, content): an archive a book. A book's members meet in one task, as they do in its file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("content", pa.binary())])
        book, out, archive, done, size = None, None, None, [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                own, name, data = (c[i].as_py() for c in batch.columns)
                if archive is None or own != book:
                    if archive is not None:
                        archive.close()
                        done.append((book, out.getvalue()))
                        size += len(done[-1][1])
                        if size >= FRAME_BYTES or len(done) >= FRAME_ROWS:
                            yield _batch(done, schema)
                            done, size = [], 0
                    book, out = own, io.BytesIO()
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        if archive is not None:
            archive.close()
            yield _batch([*done, (book, out.getvalue())], schema)

    return members.select("book", "idx", "name", "content").repartition("book").sortWithinPartitions("book", "idx").select("book", "name", "content").mapInArrow(run, "path string, content binary")


def _small(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > packages.MEMBER_BYTES:
        raise ValueError(f"member too large: {name}")
    return z.read(name)


def scan_books(spark: SparkSession, path: str, rules: markup.Rules = markup.Rules(), only_files: str = "", exclude_files: str = "", translate_metadata: bool = False, translate_title: bool = False) -> DataFrame:
    """All elements of the EPUBs under a path, as of scan_files."""
    return scan_files(epub_files(spark, path), rules, only_files, exclude_files, translate_metadata, translate_title)


def scan_files(files: DataFrame, rules: markup.Rules = markup.Rules(), only_files: str = "", exclude_files: str = "", translate_metadata: bool = False, translate_title: bool = False) -> DataFrame:
    """All elements of the EPUBs files(path, content), keyed and in reading order: metadata, contents, then text.

    (book, ord, kind, page, key, raw, original, ignored, id, signature). A book
    whose archive breaks a limit, or lacks a text file, raises. The files are
    read twice: once for that, without their text, and once for the elements,
    a book by one task.
    """

    def faults(book: str, data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            listed = z.infolist()
            if bad := packages.violation_of((m.filename, m.file_size, m.compress_size) for m in listed):
                yield (f"{book}: {bad[1]}: {bad[0]}",)
                return
            path, xml = _package(z)
            told = packages.package_of(xml)
            held = {m.filename for m in listed}
            for href in _text_files(told):
                if _selected(href, only_files, exclude_files) and _resolved(path, href) not in held:
                    yield (f"{book}: the file {href} is missing",)

    def elements(book: str, data: bytes) -> Iterator[tuple]:
        compiled = rules.compiled()
        for ord_, (kind, page, key, raw, original, ignored) in enumerate(_elements(data, compiled, only_files, exclude_files, translate_metadata, translate_title)):
            yield book, page, kind, key, raw, original, ignored, ord_

    bad = _rows_of(files.select("path", "content"), faults, T._parse_datatype_string("what string")).agg(F.min("what")).first()[0]
    if bad:
        raise ValueError(bad)
    found = _rows_of(files.select("path", "content"), elements, T._parse_datatype_string(markup.UNIT + ", ord long"))
    return markup.keyed_elements(found)


def _package(z: zipfile.ZipFile) -> tuple[str, str]:
    """Where the package file is, found through the container, and what it holds."""
    path = packages.container_path(markup.decode_page(_small(z, "META-INF/container.xml")))
    return path, markup.decode_page(_small(z, path))


def _elements(data: bytes, rules, only_files: str, exclude_files: str, metadata: bool, title: bool) -> Iterator[tuple]:
    """(kind, page, key, raw, original, ignored) of a book's elements in reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        path, xml = _package(z)
        told = packages.package_of(xml)
        for key, field, text in packages.metadata_units(xml):
            yield "metadata", path, key, field, text, not (metadata or title and field == "title")
        item, form = _used_contents(told)
        if item and (at := _resolved(path, item[1])) in z.NameToInfo:
            page = markup.decode_page(z.read(at))
            for k, raw, text in markup.nav_units(page) if form == "nav" else ((k, "text", t) for k, t in packages.ncx_units(page)):
                yield "toc", item[1], str(k), raw, text, False
        for href in _text_files(told):
            if _selected(href, only_files, exclude_files):
                for k, raw, text, ignored in markup.body_units(markup.decode_page(z.read(_resolved(path, href))), rules):
                    yield "body", href, str(k), raw, text, ignored


def rewrite_epub(data: bytes, translations: dict[str, str], rules: markup.Rules, look: markup.Look, title: str | None = None, only_files: str = "", exclude_files: str = "") -> tuple[bytes, int]:
    """The archive with translations in its package, contents and text, and how many; members that don't change are copied in place."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        read = {m.filename: m for m in z.infolist()}
        path = packages.container_path(markup.decode_page(z.read("META-INF/container.xml")))
        xml = markup.decode_page(z.read(path))
        told = packages.package_of(xml)
        changed: dict[str, str] = {}
        changed[path], n = packages.rewrite_metadata(xml, path, translations, look.position, told["title"] if title is None else title)
        used, form = _used_contents(told)
        if used and (at := _resolved(path, used[1])) in read:
            inject = markup.inject_nav if form == "nav" else packages.rewrite_ncx
            changed[at], k = inject(markup.decode_page(z.read(at)), used[1], translations, look.position)
            n += k
        compiled = rules.compiled()
        for href in _text_files(told):
            if _selected(href, only_files, exclude_files):
                at = _resolved(path, href)
                page = markup.decode_page(z.read(at))
                new, k = markup.inject_body(page, href, translations, compiled, look)
                if k:
                    changed[at] = new
                    n += k
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as w:
            for name, m in read.items():
                w.writestr(m, changed[name].encode() if name in changed else z.read(name), m.compress_type)
    return out.getvalue(), n


def rewrite_books(files: DataFrame, translations: DataFrame, rules: markup.Rules = markup.Rules(), look: markup.Look = markup.Look(), title: str | None = None, only_files: str = "", exclude_files: str = "") -> DataFrame:
    """files(path, content) with translations(book, id, translation) of their path put in: (path, content, injected), the last how many."""
    said = translations.filter(F.col("translation").isNotNull()).groupBy(F.col("book").alias("path")).agg(F.map_from_entries(F.collect_list(F.struct("id", "translation"))).alias("said"))  # one book's text, which its file holds too

    def rows(path: str, data: bytes, told: list | None) -> Iterator[tuple]:
        yield path, *rewrite_epub(data, dict(told or []), rules, look, title, only_files, exclude_files)

    return _rows_of(files.select("path", "content").join(said, "path", "left").select("path", "content", "said"), rows, T._parse_datatype_string("path string, content binary, injected long"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """files(path, content, injected) as (path, injected, place): each written by its task to a hidden file of the folder, which the driver gives its name.

    The folder must be one that driver and executors share. A task that runs
    twice leaves two files; the one that counts is the one it tells of.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, data, n in zip(pdf["path"], pdf["content"], pdf["injected"], strict=True):
                handle, place = tempfile.mkstemp(dir=folder, prefix=HIDDEN)
                with os.fdopen(handle, "wb") as f:
                    f.write(data)
                yield pd.DataFrame({"path": [path], "injected": [n], "place": [place]})

    return files.select("path", "content", "injected").mapInPandas(run, "path string, injected long, place string")


def _resolved(base: str, href: str) -> str:
    from urllib.parse import unquote

    parts: list[str] = []
    folder = base.replace("\\", "/").rpartition("/")[0]
    for part in (folder + "/" + unquote(href.split("?")[0].split("#")[0].replace("\\", "/"))).split("/"):
        if part == "..":
            parts = parts[:-1]
        elif part not in ("", "."):
            parts.append(part)
    return "/".join(parts)


def _selected(href: str, only: str, exclude: str) -> bool:
    wanted, unwanted = set(names.names_of(only)), set(names.names_of(exclude))
    ways = {href.lower(), href.rpartition("/")[2].lower()}
    return (not wanted or bool(ways & wanted)) and not ways & unwanted


def _used_contents(told: dict) -> tuple:
    """The item that is the table of contents, the first nav one or else the first NCX, and its format; None for both without any."""
    if nav := next((i for i in told["items"] if "nav" in i[3]), None):
        return nav, "nav"
    ncx = next((i for i in told["items"] if i[2].lower() == packages.NCX or told["toc"] and i[0] == told["toc"]), None)
    return ncx, "ncx" if ncx else None


def _text_files(told: dict) -> list[str]:
    """The text files: those of the spine where it names them first, then the rest by href; of items with one href the first stands for it."""
    used = _used_contents(told)[0]

    def text(i) -> bool:
        return "nav" not in i[3] and not (used and i[0] == used[0]) and i[2].lower() != packages.NCX and ("html" in i[2] or i[2] in ("application/xml", "text/xml") or i[1].lower().endswith((".xhtml", ".html", ".htm", ".xht", ".xml")))

    by_id = {i[0]: i[1] for i in told["items"]}
    first = {}
    for i in told["items"]:
        first.setdefault(i[1], i)
    order = dict.fromkeys(h for r in told["idrefs"] if (h := by_id.get(r)) is not None and text(first[h]))
    return [*order, *sorted(h for h, i in first.items() if h not in order and text(i))]


class EpubSource(DataSource):
    """spark.read.format("epub").load(path): the members of EPUB files on a file system that the workers see, an archive a partition."""

    @classmethod
    def name(cls) -> str:
        return "epub"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> EpubReader:
        return EpubReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> EpubWriter:
        return EpubWriter(self.options["path"])


class EpubReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.lower().endswith(".epub") and not f.startswith("."))
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.value) as z:
            for i, m in enumerate(z.infolist()):
                yield partition.value, i, m.filename, m.file_size, m.compress_size, z.read(m) if m.file_size <= packages.MEMBER_BYTES else None


@dataclass
class Written(WriterCommitMessage):
    #: Hidden files of a task with the names they are to take.
    files: list[tuple[str, str]]


class EpubWriter(DataSourceWriter):
    """Writes members, grouped by book and sorted by idx within a partition, as archives: to hidden files that take their names when all tasks are done."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        book, archive, done = None, None, []
        try:
            for r in rows:
                if r.book != book:
                    if archive is not None:
                        archive.close()
                    book = r.book
                    handle, temp = tempfile.mkstemp(dir=self.path, prefix=HIDDEN)
                    os.close(handle)
                    done.append((temp, os.path.join(self.path, os.path.basename(book))))
                    archive = zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(r.name, bytes(r.content), zipfile.ZIP_STORED if r.name == "mimetype" else None)
            if archive is not None:
                archive.close()
        except BaseException:
            _discard(done)
            raise
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for temp, name in m.files if m else []:
                os.replace(temp, name)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            _discard(m.files if m else [])


def _discard(files: list[tuple[str, str]]) -> None:
    for temp, _ in files:
        if os.path.exists(temp):
            os.remove(temp)
