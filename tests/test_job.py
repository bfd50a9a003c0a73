import json
import zipfile

import pytest

from folioflow.config import Config, ConfigError, EngineConfig
from folioflow.functions import keys
from folioflow.job import Job
from folioflow.operators.translate import FunctionEngine, ServiceError

from .book import epub


def config(tmp_path, **more):
    return Config(cache_dir=str(tmp_path / "cache"), merge_length=40, engines={"openai": EngineConfig(request_interval=0.0, retry_delay=0.0)}, **more)


@pytest.fixture
def book(tmp_path):
    path = tmp_path / "in.epub"
    path.write_bytes(epub())
    return str(path)


def page(path, name="OEBPS/extra.xhtml"):
    with zipfile.ZipFile(path) as z:
        return z.read(name).decode()


def test_run_resume_and_review(spark, tmp_path, book):
    c = config(tmp_path)
    out = str(tmp_path / "out.epub")
    job = Job(spark, c, [FunctionEngine(lambda t: "T " + t)])
    first = job.run(book, out)
    assert first.ok and (first.translated, first.total, first.failed) == (6, 6, 0)
    assert "T Notes here." in page(out) and "T First one" in page(out, "OEBPS/nav.xhtml")
    with pytest.raises(ConfigError):
        job.run(book, out)

    def never(text):
        raise AssertionError("asked again")

    again = Job(spark, c, [FunctionEngine(never)]).run(book, str(tmp_path / "two.epub"))
    assert again.ok and again.key == first.key
    review = tmp_path / "review.json"
    job.export_review(book, str(review))
    part = next(review.glob("part-*.txt"))
    told = json.loads(part.read_text())
    assert told["schema_version"] == 1 and [p["kind"] for p in told["paragraphs"]][:4] == ["metadata"] * 3 + ["toc"]
    for p in told["paragraphs"]:
        if p["original"] == "Notes here.":
            p["translation"] = "By hand."
    edited = tmp_path / "edited.json"
    edited.write_text(json.dumps(told))
    done = job.run(book, out, force=True, review_file=str(edited))
    assert done.ok and "By hand." in page(out)
    told["paragraphs"][0]["original"] = "other"
    edited.write_text(json.dumps(told))
    with pytest.raises(ValueError, match="stale"):
        job.run(book, out, force=True, review_file=str(edited))


def test_failures_and_ranges(spark, tmp_path, book):
    def fails(text):
        if "Notes" in text:
            raise ServiceError("HTTP 500", 500)
        return "T " + text

    c = config(tmp_path)
    half = Job(spark, c, [FunctionEngine(fails)]).run(book, str(tmp_path / "o.epub"))
    assert not half.ok and half.failed == 1 and half.translated == 5
    whole = Job(spark, c, [FunctionEngine(lambda t: "U " + t)]).run(book, str(tmp_path / "o.epub"))
    assert whole.ok and "U Notes here." in page(tmp_path / "o.epub")
    ranged = Job(spark, c.override(retranslate_file="extra.xhtml", retranslate_start="Notes"), [FunctionEngine(lambda t: "V " + t)]).run(book, str(tmp_path / "o.epub"), force=True)
    assert ranged.ok and "V Notes here." in page(tmp_path / "o.epub") and "T First one" in page(tmp_path / "o.epub", "OEBPS/nav.xhtml")


def test_lost_run_keeps_its_waves(spark, tmp_path, book):
    job = Job(spark, config(tmp_path), [FunctionEngine(lambda t: "T " + t)])
    job.WAVE = 1
    store, waves = job.store.add_wave, []

    def lost(key, outcomes):
        if len(waves) == 2:
            raise RuntimeError("lost")
        waves.append(store(key, outcomes))
        return waves[-1]

    job.store.add_wave = lost
    with pytest.raises(RuntimeError, match="lost"):
        job.run(book, str(tmp_path / "o.epub"))
    kept = sum(w.count() for w in waves)
    again = Job(spark, config(tmp_path), [FunctionEngine(lambda t: "U " + t)])
    done = again.run(book, str(tmp_path / "o.epub"))
    said = [r.translation for r in again.store.read(done.key).filter("translation is not null").collect()]
    assert done.ok and 0 < kept < 6 and len(said) == 6 and sum(t.startswith("T ") for t in said) == kept
    assert again.store._waves(done.key) == ([], [])


def test_stopped_wave_ends_the_run(spark, tmp_path, book):
    def fails(text):
        raise ServiceError("HTTP 400", 400)

    job = Job(spark, config(tmp_path, max_error_count=1), [FunctionEngine(fails)])
    job.WAVE = 2
    assert job.run(book, str(tmp_path / "o.epub")).failed == 6


def test_dry_run_and_folder(spark, tmp_path, book):
    job = Job(spark, config(tmp_path, test_enabled=True, test_num=2).override(), [FunctionEngine(lambda t: "T " + t)])
    assert [r.extension for r in job.dry_run(str(tmp_path / "*.epub")).collect()] == ["epub"]
    done, code = job.run_all(str(tmp_path / "*.epub"), str(tmp_path / "all"))
    assert code == 0 and done[0].translated == 2


def test_config_checks():
    told = Config.from_dict({"engine": "claude", "claude": {"model": "m", "max_tokens": 5}, "openai": {"model": "flat"}, "engines": {"openai": {"model": "nested"}}, "column_gap": {"_type": "space_count", "space_count": 2}, "unknown": 1})
    assert told.engines["openai"].model == "nested" and told.engines["claude"].extra == {"max_tokens": 5} and told.column_gap.kind == "space_count"
    assert told.validate() is told
    for bad in ({"engine": "x"}, {"rule_mode": "x"}, {"prompt": "none"}, {"target_lang_code": "a"}, {"priority_rules": ["["]}, {"rule_mode": "regex", "filter_rules": ["("]}, {"input_encoding": "x"}, {"max_error_count": 0}, {"engines": {"openai": {"concurrency": 0}}}, {"engines": {"claude": {"temperature": 1.5}}}, {"engines": {"openai": {"top_p": 2.0}}}, {"engines": {"openai": {"extra": {"max_tokens": 0}}}}):
        with pytest.raises(ConfigError):
            Config.from_dict(bad).validate()
    with pytest.raises(ConfigError):
        Config.from_dict({"engines": {"openai": {"nope": 1}}})
    with pytest.raises(ConfigError):
        Config().override(retranslate_file="x")
    assert keys.canonical_json({"b": [1, True, None], "a": "é"}) == '{"a": "é", "b": [1, true, null]}'
    one, two = (Config(target_lang=t).key_settings("m", "s", []) for t in ("A", "B"))
    assert keys.cache_key(one) != keys.cache_key(two) and keys.cache_key(one) == keys.cache_key(Config(target_lang="A", translation_position="only").key_settings("m", "s", []))
