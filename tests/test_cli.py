import json
import os
import time

import pytest
from pyspark.sql import functions as F

from folioflow import cli
from folioflow.config import ConfigError
from folioflow.functions import paths
from folioflow.job import Job
from folioflow.operators.translate import FunctionEngine
from folioflow.sources import books, convert

from .book import epub
from .test_job import config, page


def program(tmp_path, body, name="converter"):
    path = tmp_path / name
    path.write_text("#!/bin/sh\n" + body + "\n")
    path.chmod(0o755)
    return str(path)


def settings(tmp_path, **more):
    path = tmp_path / "config.json"
    quick = {"openai": {"request_interval": 0.0, "retry_delay": 0.0}}
    path.write_text(json.dumps({"cache_dir": str(tmp_path / "cache"), "merge_length": 40, "engines": quick} | more))
    return str(path)


def test_converter_and_its_errors(spark, tmp_path):
    files = spark.createDataFrame([("x/a.mobi", b"one"), ("x/b.EPUB", b"two")], "path string, content binary")
    made = convert.convert_books(files, converter=program(tmp_path, 'cat "$1" > "$2"; echo "$3 $4" >> "$2"'), encoding="GBK").collect()
    assert {r.path: (bytes(r.content), r.error) for r in made} == {"x/a.mobi": (b"one--input-encoding GBK\n", None), "x/b.EPUB": (b"two", None)}
    says = lambda body, seconds=60.0: convert.convert_books(files.limit(1), converter=program(tmp_path, body, "p"), seconds=seconds).first().error
    assert "(3)" in says("echo broken >&2; exit 3") and "broken" in says("echo broken >&2; exit 3")
    assert "no file" in says("exit 0")
    began = time.time()
    assert "over 1 seconds" in says("sleep 600", 1.0) and time.time() - began < 60
    with pytest.raises(convert.ConvertError):
        convert.find_converter("no/such/program")
    with pytest.raises(convert.ConvertError):
        convert.find_converter("no-such-program")


def test_paths(tmp_path):
    one = tmp_path / "one.epub"
    one.write_text("x")
    os.symlink(one, tmp_path / "link.epub")
    os.symlink(tmp_path, tmp_path / "again")
    assert paths.same_file(str(one), str(tmp_path / "link.epub"))
    assert paths.same_file(str(tmp_path / "again" / "new"), str(tmp_path / "x" / ".." / "new")) and not paths.same_file(str(one), str(tmp_path / "new"))
    out = str(tmp_path / "o.mobi")
    assert paths.spare_name(out, str(one)) == str(tmp_path / "o.translated.epub")
    (tmp_path / "o.translated.epub").write_text("")
    assert paths.spare_name(out, str(one)) == str(tmp_path / "o.translated-2.epub")


def test_folder_of_formats(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.epub").write_bytes(epub())
    (source / "b.mobi").write_bytes(epub(**{"OEBPS/extra.xhtml": "<html><body><p>Other notes.</p></body></html>"}))
    (source / "a.fb2").write_bytes(epub())
    told = ["-c", settings(tmp_path, ebook_convert_path=program(tmp_path, 'cp "$1" "$2"')), "--log-file", str(tmp_path / "logs" / "log")]
    engine = [FunctionEngine(lambda t: "T " + t)]
    assert cli.main([str(source), "--dry-run", *told], spark, engine) == 0
    # two books of one name: the second one fails, the others don't
    assert cli.main([str(source), str(out), *told], spark, engine) == 1
    assert sorted(os.listdir(out)) == ["a.epub", "b.epub"] and "T Other notes." in page(out / "b.epub")
    lines = (tmp_path / "logs" / "log").read_text().splitlines()
    assert all(x.split()[0].isdigit() for x in lines) and any("[ERROR]" in x and "two books" in x for x in lines)
    # what is there stays; by title, and in another format
    (source / "a.fb2").unlink()
    assert cli.main([str(source), str(out), *told], spark, [FunctionEngine(lambda t: 1 / 0)]) == 0
    assert cli.main([str(source / "a.epub"), str(out), "-o", "mobi", "--translate-title", *told], spark, engine) == 0
    assert sorted(os.listdir(out)) == ["T A & B!.mobi", "a.epub", "b.epub"]


def test_output_that_fails_to_convert_stays_an_epub(spark, tmp_path):
    book = tmp_path / "in.epub"
    book.write_bytes(epub())
    told = ["-c", settings(tmp_path, ebook_convert_path=program(tmp_path, "exit 1"))]
    assert cli.main([str(book), str(tmp_path / "out"), "-o", "azw3", "--custom-title", "My: own", *told], spark, [FunctionEngine(lambda t: "T " + t)]) == 1
    assert os.listdir(tmp_path / "out") == ["My_ own.translated.epub"]


def test_preconditions(spark, tmp_path):
    book = tmp_path / "in.epub"
    book.write_bytes(epub())
    (tmp_path / "two").mkdir()
    for n in "ab":
        (tmp_path / "two" / f"{n}.epub").write_bytes(epub())
    job = Job(spark, config(tmp_path), [FunctionEngine(lambda t: "T " + t)])
    out = str(tmp_path / "out")
    for args in ((str(book), None), (str(tmp_path / "two"), out, False, "epub", "review"), (str(book), out, False, "epub", None, "r.json", True), (str(book), out, False, "pdf")):
        with pytest.raises(ConfigError):
            job.run_all(*args)
    with pytest.raises(ConfigError):
        job.run(str(book), str(tmp_path / "two" / ".." / "in.epub"), force=True)
    assert cli.main([str(book), "--concurrency", "1000", "-c", settings(tmp_path)], spark) == 1
    assert cli.settings(cli.parser().parse_args([str(book), "--input-encoding", "utf-8", "--concurrency", "7", "--test", "-c", settings(tmp_path)])).engine_config().concurrency == 7


def test_book_that_takes_too_long(spark, tmp_path):
    book = tmp_path / "in.epub"
    book.write_bytes(epub())
    job = Job(spark, config(tmp_path), [FunctionEngine(lambda t: time.sleep(600) or t)])
    job.BOOK_SECONDS = 8.0
    began = time.time()
    done, code = job.run_all(str(book), str(tmp_path / "out"))
    assert code == 1 and not done[0].ok and time.time() - began < 120
    assert spark.range(3).count() == 3


def test_archives_in_rows(spark):
    members = spark.createDataFrame([("b", 1, "x", b"2"), ("b", 0, "mimetype", b"1"), ("c", 0, "y", b"3")], "book string, idx int, name string, content binary")
    again = books.members_of(books.pack_members(members)).select("book", "idx", "name", F.decode("content", "UTF-8").alias("c"))
    assert sorted(map(tuple, again.collect())) == [("b", 0, "mimetype", "1"), ("b", 1, "x", "2"), ("c", 0, "y", "3")]
