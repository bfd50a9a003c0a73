import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow.operators import markup, packages
from folioflow.sources import books

from .book import NCX, NAV, OPF, epub


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.epub").write_bytes(epub())
    (tmp_path / ".hidden.epub").write_bytes(b"x")
    (tmp_path / "b.MOBI").write_bytes(b"x")
    (tmp_path / "c.exe").write_bytes(b"x")
    return tmp_path


def test_listing(spark, folder):
    assert [(r.path.rsplit("/", 1)[1], r.extension) for r in books.list_books(spark, str(folder)).collect()] == [("a.epub", "epub"), ("b.MOBI", "mobi")]


def test_scan(spark, folder):
    (folder / ".hidden.epub").unlink()
    rows = books.scan_books(spark, str(folder / "a.epub")).orderBy("ord").collect()
    assert [(r.kind, r.page, r.key, r.original, r.ignored) for r in rows] == [
        ("metadata", "OEBPS/content.opf", "title:0", "A & B!", True), ("metadata", "OEBPS/content.opf", "creator:0", "Me", True), ("metadata", "OEBPS/content.opf", "creator:2", "You", True),
        ("toc", "nav.xhtml", "0", "First one", False), ("toc", "nav.xhtml", "2", "Next", False),
        ("body", "Text/c%20one.xhtml", "0", "Title", False), ("body", "Text/c%20one.xhtml", "1", "Hello {{etm_o_00000}}big{{etm_c_00000}} world{{etm_n_00001}}.", False),
        ("body", "Text/c%20one.xhtml", "2", "12.5", True), ("body", "Text/c%20one.xhtml", "3", "item", False), ("body", "extra.xhtml", "0", "Notes here.", False),
    ]
    assert len({r.id for r in rows}) == len(rows)
    assert books.scan_books(spark, str(folder / "a.epub"), only_files="EXTRA.xhtml").filter("kind = 'body'").count() == 1


def test_ncx_and_missing_files(spark, tmp_path):
    old = OPF.replace(' properties="nav"', "").replace('href="nav.xhtml" media-type="application/xhtml+xml"', 'href="toc.ncx" media-type="application/x-dtbncx+xml"')
    (tmp_path / "n.epub").write_bytes(epub(**{"OEBPS/content.opf": old, "OEBPS/toc.ncx": NCX}))
    toc = books.scan_books(spark, str(tmp_path / "n.epub")).filter("kind = 'toc'").collect()
    assert [(r.key, r.original) for r in toc] == [("0", "Only")]
    (tmp_path / "m.epub").write_bytes(epub(**{"OEBPS/extra.xhtml": None}))
    with pytest.raises(ValueError, match="missing"):
        books.scan_books(spark, str(tmp_path / "m.epub"))


def test_rewriting():
    ids = {packages.keys.uid_of("metadata", "OEBPS/content.opf", "creator:2"): "Du", packages.keys.uid_of("toc", "nav.xhtml", 0): "Eins", packages.keys.uid_of("body", "extra.xhtml", 0): "Notizen."}
    data, n = books.rewrite_epub(epub(), ids, markup.Rules(), markup.Look(position="below"), "New <title>")
    assert n == 3
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(io.BytesIO(epub())) as old:
        assert z.namelist() == old.namelist()
        opf = z.read("OEBPS/content.opf").decode()
        assert "<dc:title>New &lt;title&gt;</dc:title>" in opf and "<dc:creator>You Du</dc:creator>" in opf and "<dc:creator>Me</dc:creator>" in opf
        assert "First one Eins" in z.read("OEBPS/nav.xhtml").decode()
        assert "Notizen." in z.read("OEBPS/extra.xhtml").decode()
        assert z.read("OEBPS/Text/c one.xhtml") == old.read("OEBPS/Text/c one.xhtml") and z.read("OEBPS/i.png") == b"\x89PNG"
    xml, k = packages.rewrite_ncx(NCX, "toc.ncx", {packages.keys.uid_of("toc", "toc.ncx", 0): "Nur"}, "only")
    assert k == 1 and "<text>Nur</text>" in xml and "<text> </text>" in xml


def test_data_source_round_trip(spark, folder, tmp_path_factory):
    spark.dataSource.register(books.EpubSource)
    members = spark.read.format("epub").load(str(folder / "a.epub"))
    assert members.count() == 7
    out = tmp_path_factory.mktemp("out")
    members.repartition(2, "book").sortWithinPartitions("book", "idx").write.format("epub").mode("append").save(str(out))
    with zipfile.ZipFile(out / "a.epub") as z:
        assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.read("OEBPS/nav.xhtml").decode() == NAV


def test_violations(spark):
    rows = [("b", 0, "x", 10, 5), ("b", 1, "x", 10, 5), ("b", 2, "y", 300 << 20, 1 << 20), ("b", 3, "z", 200 << 20, 1000), ("c", 0, "x", 1, 0)]
    got = packages.archive_violations(spark.createDataFrame(rows, "book string, idx int, name string, size long, csize long")).orderBy("idx").collect()
    assert [(r.book, r.idx, r.violation) for r in got] == [("b", 1, "repeated name"), ("b", 2, "member too large"), ("b", 3, "suspicious ratio")]
    big = spark.range(30).select(F.lit("d").alias("book"), F.col("id").cast("int").alias("idx"), F.col("id").cast("string").alias("name"), F.lit(200 << 20).alias("size"), F.lit(200 << 20).alias("csize"))
    assert {r.violation for r in packages.archive_violations(big).collect()} == {"archive too large"}


def test_scan_reads_each_book_in_one_pass(spark, folder, capsys):
    (folder / ".hidden.epub").unlink()
    books.scan_books(spark, str(folder)).explain()
    plan = capsys.readouterr().out
    assert plan.count("MapInArrow") + plan.count("MapInPandas") == 1 and "Exchange" not in plan


def test_a_file_that_the_manifest_names_twice_is_read_once(spark, tmp_path):
    twice = OPF.replace('<item id="i"', '<item id="x2" href="extra.xhtml" media-type="application/xhtml+xml"/><item id="i"')
    (tmp_path / "t.epub").write_bytes(epub(**{"OEBPS/content.opf": twice}))
    rows = books.scan_books(spark, str(tmp_path / "t.epub")).filter("page = 'extra.xhtml'").collect()
    assert [(r.key, r.original) for r in rows] == [("0", "Notes here.")]
    said = {packages.keys.uid_of("body", "extra.xhtml", 0): "Notizen."}
    assert books.rewrite_epub((tmp_path / "t.epub").read_bytes(), said, markup.Rules(), markup.Look())[1] == 1


def test_violations_stop_a_scan(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "r.epub", "w") as z, pytest.warns(UserWarning, match="Duplicate"):
        z.writestr("a", "1")
        z.writestr("a", "2")
    with pytest.raises(ValueError, match="r.epub: repeated name: a"):
        books.scan_books(spark, str(tmp_path / "r.epub"))


def test_members_with_columns_of_their_archive(spark):
    files = spark.createDataFrame([("p", epub(), 3)], "path string, content binary, injected long")
    rows = books.members_of(files, keep=("injected",)).orderBy("idx").collect()
    assert len(rows) == 7 and {(r.book, r.injected) for r in rows} == {("p", 3)} and rows[0].name == "mimetype"
