"""A whole run over a folder of books: scan, resume, translate, review, write."""

from __future__ import annotations

import logging
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config, ConfigError
from .functions import keys, names, paths
from .operators import checkpoint, packing, review
from .operators.glossary import Glossary, read_glossary
from .operators.translate import Engine, HttpEngine, batch_results, translate_groups
from .sources import books, convert

log = logging.getLogger("folioflow")


@dataclass
class Outcome:
    book: str
    key: str
    translated: int
    total: int
    failed: int
    output: str | None
    #: The output was there before, and stays.
    skipped: bool = False
    #: The output is an EPUB, as it couldn't be converted.
    fallback: bool = False

    @property
    def ok(self) -> bool:
        return self.output is not None and not self.fallback


class EmptyBook(ValueError):
    pass


class Job:
    """Runs of one configuration. Engines may be given; else they come from the settings."""

    #: Batches sent before their outcomes are stored.
    WAVE = 64

    #: A book that takes longer is given up; what it has stored stays.
    BOOK_SECONDS = 14_400.0

    def __init__(self, spark: SparkSession, config: Config, engines: list[Engine] | None = None):
        self.spark, self.config = spark, config.validate()
        pairs = read_glossary(spark, config.glossary_path, config.glossary) if config.glossary_path else Glossary([]).pairs
        self.glossary = Glossary(pairs or _inline(config.glossary))
        self.engines = engines or [self._http(config.engine), *(self._http(n) for n in config.engines if n != config.engine)]
        self.scratch = paths.run_folder(spark)
        self.store = checkpoint.Checkpoint(spark, os.path.expanduser(config.cache_dir) if config.cache_enabled else f"{self.scratch}/checkpoint")

    def close(self) -> None:
        """Removes what was kept for this job alone: converted books, and the checkpoint of a job without one."""
        paths.remove(self.spark, self.scratch)

    def _http(self, name: str) -> HttpEngine:
        e = self.config.engine_config(name)
        settings = {"sampling": e.sampling, "temperature": e.temperature, "top_p": e.top_p, "extra": e.extra, "stream": e.stream}
        kind = name if name in ("claude", "deeplx", "deepx") else "openai"
        codes = self.spark.range(1).select(*(names.service_language(F.lit(x)) for x in (self.config.source_lang, self.config.target_lang))).first()
        suffix = {"claude": "/v1/messages", "openai": "/v1/chat/completions"}.get(kind, "")
        url = self.spark.range(1).select(names.endpoint_url(F.lit(e.base_url), suffix)).first()[0] if suffix and e.base_url else e.base_url
        return HttpEngine(name, url, e.model, kind, e.api_key, settings, e.request_timeout, tuple(codes))

    def dry_run(self, path: str) -> DataFrame:
        """What a run would read: (path, extension, size)."""
        return books.list_books(self.spark, path).select("path", "extension", names.human_size(F.col("length")).alias("size"))

    def _kept(self, rows: DataFrame) -> DataFrame:
        """The rows as stored, until the job is closed."""
        place = f"{self.scratch}/rows-{uuid.uuid4().hex}"
        rows.write.parquet(place)
        return self.spark.read.parquet(place)

    def files(self, path: str) -> DataFrame:
        """(path, content) of one book as an EPUB; one of another format is converted, and kept as a row until the job is closed."""
        c = self.config
        files = self.spark.read.format("binaryFile").load(path).select(F.lit(path).alias("path"), "content")
        if path.lower().endswith(f".{books.NATIVE}"):
            if c.input_encoding:
                log.info("input_encoding is for the converter: %s is read without it", path)
            return files
        made = self._kept(convert.convert_books(files, books.NATIVE, c.ebook_convert_path, c.input_encoding))
        wrong = made.filter("error is not null").select("error").first()
        if wrong:
            raise convert.ConvertError(f"{path}: {wrong.error}")
        return made.select("path", "content")

    def elements(self, files: DataFrame) -> DataFrame:
        c = self.config
        return books.scan_files(files, c.rules(), c.only_files, c.exclude_files, c.metadata_translation, c.translate_title)

    def prepare(self, path: str, files: DataFrame | None = None) -> tuple[str, str, str, DataFrame]:
        """(key, md5, signature, elements) of one book, with its checkpoint brought up to its text."""
        md5 = self.spark.read.format("binaryFile").load(path).select(F.md5("content").alias("m")).first()["m"]
        elements = self.elements(self.files(path) if files is None else files)
        signature = keys.element_signature(elements, [], ["ord"]).first()["element_signature"]
        if signature == keys.OF_NOTHING:
            raise EmptyBook(f"{path} holds nothing to translate")
        key = keys.cache_key(self.config.key_settings(md5, signature, self.glossary.pairs))
        rows = checkpoint.as_rows(elements.withColumn("cache_key", F.lit(key)))
        self.store.fold(key)  # what a lost run has stored
        self.store.write(key, checkpoint.upsert(self.store.read(key), rows))
        return key, md5, signature, elements

    def run(self, path: str, output: str, force: bool = False, retranslate_all: bool = False, review_file: str | None = None) -> Outcome:
        """Translates one book; what an earlier run of the same settings has done is kept."""
        if os.path.exists(output) and not force:
            raise ConfigError(f"{output} exists already")
        self._check_target(path, output, [])
        return self._book(path, lambda title: output, True, retranslate_all, review_file)

    def _check_target(self, path: str, output: str, produced: list[str]) -> None:
        if paths.same_file(path, output):
            raise ConfigError("the output would replace the input")
        if any(paths.same_file(p, output) for p in produced):
            raise ConfigError(f"two books would be written to {output}")

    def _book(self, path: str, name: Callable[[str], str], force: bool, retranslate_all: bool, review_file: str | None, output_format: str = books.NATIVE) -> Outcome:
        """One book to the file that `name` gives for its final title; a file that is there stays unless forced."""
        c = self.config
        files = self.files(path)
        key, md5, signature, elements = self.prepare(path, files)
        rows = self.store.read(key)
        if review_file:
            self.import_review(key, review_file, md5, signature, elements)
        elif retranslate_all:
            log.info("%s: %d units are to be done again", path, checkpoint.cleared(rows).first()["n"])
            self.store.write(key, checkpoint.clear(rows))
        if c.retranslate_start:
            rows = self.store.read(key)
            chosen = packing.range_selection(rows.withColumn("book", F.lit("")), c.retranslate_start, c.retranslate_end, c.retranslate_file)
            self.store.write(key, checkpoint.clear(rows, chosen.select("id")))
        failed = self.translate(key)
        done = checkpoint.counts(self.store.read(key)).first()
        missing = done["total"] - done["translated"]
        log.info("%s: %d of %d units done, %d failed", path, done["translated"], done["total"], failed)
        outcome = Outcome(path, key, done["translated"], done["total"], failed, None)
        if missing and not c.skip_failed:
            return outcome
        title = self.title(path, elements, key)
        output = name(title)
        if os.path.exists(output) and not force:
            log.info("%s exists already", output)
            return replace(outcome, output=output)
        return replace(outcome, **self.write(key, path, output, files, title, output_format))

    def title(self, path: str, elements: DataFrame, key: str) -> str:
        """The book's final title: the one that is set, or its own, translated as the settings say; of a book without one, the file's name."""
        c = self.config
        first = elements.filter("kind = 'metadata' and raw = 'title'").orderBy("ord").limit(1).select("id", "original")
        found = first.join(self.store.read(key).select("id", "translation"), "id", "left").first()
        original = found["original"] if found else os.path.splitext(os.path.basename(path))[0]
        said = F.lit(found["translation"] if found else None).cast("string")
        chosen = names.select_title(F.lit(original), said, c.custom_title, c.translate_title, c.metadata_translation, c.translation_position)
        return self.spark.range(1).select(chosen.alias("t")).first()["t"]

    def output_path(self, folder: str, title: str, output_format: str) -> str:
        return os.path.join(folder, self.spark.range(1).select(names.output_filename(F.lit(title), output_format).alias("n")).first()["n"])

    def translate(self, key: str) -> int:
        """Sends what is pending and stores what comes back; the number of units that failed.

        Batches go in waves of `WAVE`. A wave's outcomes are stored before the
        next one is sent, so a lost run loses one wave at most; its other ones
        are folded in when the book is prepared again. Failures in a row are
        counted anew in each wave; after a wave that they stopped none is sent.
        """
        c = self.config
        rows = self.store.read(key)
        todo = checkpoint.first_pending(rows, c.test_num if c.test_enabled else 0)
        groups = packing.group_rows(packing.merge_groups(todo.withColumn("book", F.lit(key)), c.merge_length, c.merge_enabled))
        policy = c.engine_config().policy(c.max_error_count, partitions=1)  # one limit on the rate of requests
        packed = f"{self.store.path}/{key}/batches-{os.urandom(8).hex()}"
        groups.write.parquet(packed)
        groups = self.spark.read.parquet(packed)
        waves = -(-groups.count() // self.WAVE)
        wave = F.pmod(F.xxhash64("group_start"), F.lit(max(waves, 1)))
        failed = 0
        for i in range(waves):
            if i:
                time.sleep(policy.interval)
            sent = translate_groups(groups.filter(wave == i), self.engines, c.effective_prompt(), c.source_lang, c.target_lang, self.glossary, policy)
            # outcomes are stored before anything reads them twice, as reading again would ask again
            told = self.store.add_wave(key, sent.select("id", "error", F.col("text").alias("translation"), "engine_name", F.lit(c.target_lang).alias("target_lang")))
            ended = batch_results(told).first()
            failed += ended["failed"]
            if ended["stopped"]:
                failed += groups.filter(wave > i).select(F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("n")).first()["n"]
                break
        self.store.fold(key)
        return failed

    def write(self, key: str, path: str, output: str, files: DataFrame, title: str, output_format: str = books.NATIVE) -> dict:
        """The book with its translations: a task writes it to a hidden file of the output's folder, which then takes its name.

        Returns what is known of the output: where it is, and whether it had to
        stay an EPUB as the converter failed.
        """
        c = self.config
        rows = self.store.read(key).filter(F.col("translation").isNotNull()).select(F.lit(path).alias("book"), "id", "translation")
        told = self.spark.range(1).select(names.language_code(F.lit(c.target_lang), c.target_lang_code).alias("code")).select("code", names.direction(F.col("code"), c.target_direction).alias("dir")).first()
        made = books.rewrite_books(files, rows, c.rules(), c.look(told["code"], told["dir"]), title, c.only_files, c.exclude_files)
        if output_format != books.NATIVE:
            made = self._kept(made)  # it is read twice
        folder = os.path.dirname(os.path.abspath(output))
        os.makedirs(folder, exist_ok=True)
        written = books.write_files(made, folder).first()
        if not os.path.isfile(written["place"]):
            raise ValueError(f"the executors don't share the folder {folder}")
        try:
            expected = rows.count()
            if written["injected"] != expected:
                raise ValueError(f"{expected} translations, but {written['injected']} were written")
            if output_format == books.NATIVE:
                os.replace(written["place"], output)
                return {"output": output}
            source = made.select(F.lit(f"book.{books.NATIVE}").alias("path"), "content")
            converted = self._kept(convert.convert_books(source, output_format, c.ebook_convert_path))
            wrong = converted.select("error").first()["error"]
            if wrong is None:
                os.replace(books.write_files(converted.withColumn("injected", F.lit(0).cast("long")), folder).first()["place"], output)
                return {"output": output}
            spare = paths.spare_name(output, path)
            os.replace(written["place"], spare)
            log.error("%s stays an EPUB, %s: %s", path, spare, wrong)
            return {"output": spare, "fallback": True}
        finally:
            if os.path.exists(written["place"]):
                os.remove(written["place"])

    def export_review(self, path: str, to: str, force: bool = False) -> None:
        key, md5, signature, elements = self.prepare(path)
        title = elements.filter("kind = 'metadata' and raw = 'title'").orderBy("ord").limit(1).select("original").first()
        review.write_review(review.export_rows(elements, self.store.read(key)), to, md5, signature, title["original"] if title else "", force)

    def import_review(self, key: str, path: str, md5: str, signature: str, elements: DataFrame) -> None:
        """All of a review's decisions, or none if one may not be."""
        document = review.read_review(self.spark, path)
        if not review.stale(document, md5, signature).isEmpty():
            raise ValueError("the review is of another source, or out of date")
        told = review.records(document)
        wrong = review.violations(told, elements).limit(1).collect()
        if wrong:
            raise ValueError(f"review of {wrong[0].id}: {wrong[0].violation}")
        self.store.write(key, checkpoint.apply_review(self.store.read(key), review.decisions(told), self.config.engine, self.config.target_lang))

    def run_all(
        self, path: str, output: str | None, force: bool = False, output_format: str = books.NATIVE,
        review_export: str | None = None, review_file: str | None = None, retranslate_all: bool = False,
    ) -> tuple[list[Outcome], int]:
        """Every book of a folder, one after the other, and the exit code: 0 if all went well, else 1.

        A book that fails, or takes over `BOOK_SECONDS`, is logged and the next
        one follows. Files are named by the books' final titles where titles are
        set or translated, else as the input is.
        """
        c = self.config
        found = [r.path.removeprefix("file:") for r in books.list_books(self.spark, path).collect()]  # file names of a folder
        if not found:
            raise ConfigError(f"no book in {path}; known formats: {', '.join(books.EXTENSIONS)}")
        if output is None and review_export is None:
            raise ConfigError("an output folder is needed, except for a review")
        if len(found) != 1 and (review_export or review_file or c.custom_title.strip()):
            raise ConfigError("a review or a title of one's own is for one book")
        if review_file and retranslate_all:
            raise ConfigError("a review can't be imported while all is done again")
        if output_format not in convert.OUTPUTS:
            raise ConfigError(f"the output format must be one of {', '.join(convert.OUTPUTS)}")
        if output_format != books.NATIVE and review_export is None:
            convert.find_converter(c.ebook_convert_path)
        if output is not None:
            os.makedirs(output, exist_ok=True)
        done: list[Outcome] = []
        for source in found:
            produced = [o.output for o in done if o.output and not o.skipped]
            with self._limited(source) as late:
                try:
                    if review_export:
                        self.export_review(source, review_export, force)
                        outcome = Outcome(source, "", 0, 0, 0, review_export)
                    else:
                        outcome = self._into(source, output, force, output_format, produced, retranslate_all, review_file)
                except Exception as e:  # one book's error is not the next one's
                    log.error("%s: %s", source, f"over {self.BOOK_SECONDS:g} seconds" if late.is_set() else e)
                    outcome = Outcome(source, "", 0, 0, 0, None)
            done.append(outcome)
        return done, 0 if all(o.ok for o in done) else 1

    def _into(self, source: str, folder: str, force: bool, output_format: str, produced: list[str], retranslate_all: bool, review_file: str | None) -> Outcome:
        c = self.config

        def name(title: str) -> str:
            output = self.output_path(folder, title, output_format)
            self._check_target(source, output, produced)
            return output

        own = c.custom_title.strip()
        if own or not (c.translate_title or c.metadata_translation):  # the name is known before the book is read
            early = name(own or os.path.splitext(os.path.basename(source))[0])
            if os.path.exists(early) and not force:
                log.info("%s exists already", early)
                return Outcome(source, "", 0, 0, 0, early, skipped=True)
            return self._book(source, lambda title: early, force, retranslate_all, review_file, output_format)
        return self._book(source, name, force, retranslate_all, review_file, output_format)

    @contextmanager
    def _limited(self, what: str) -> Iterator[threading.Event]:
        """Spark jobs in here end after `BOOK_SECONDS`, or with an interruption; the event tells of the former."""
        context, group = self.spark.sparkContext, f"folioflow-{uuid.uuid4().hex}"
        over, late = threading.Event(), threading.Event()

        def watch() -> None:
            if not over.wait(self.BOOK_SECONDS):
                late.set()
                while not over.is_set():
                    context.cancelJobGroup(group)
                    over.wait(0.5)

        context.setJobGroup(group, what, interruptOnCancel=True)
        threading.Thread(target=watch, daemon=True).start()
        try:
            yield late
        except BaseException:
            context.cancelJobGroup(group)
            raise
        finally:
            over.set()
            for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                context.setLocalProperty(name, None)


def _inline(glossary: dict[str, str]) -> list[tuple[str, str]]:
    found = {k.strip(): v.strip() for k, v in glossary.items() if k.strip()}
    return sorted(found.items(), key=lambda p: (-len(p[0]), p[0].encode()))
