"""Settings of a run: defaults, files, overrides and checks. All of it is on the driver."""

from __future__ import annotations

import dataclasses
import json
import math
import os
import re
from dataclasses import dataclass, field

from .functions.names import ENCODINGS
from .operators import dom, markup
from .operators.translate import Policy

# Engines that are known, and limits of their settings.
ENGINES = ("claude", "deepseek", "openai", "deeplx", "deepx")
FLAT_ENGINES = ("openai", "deepseek", "claude")
CONCURRENCY_MOST, SECONDS_MOST = 256, 86400.0

PROMPT = "You are a translator. Translate the text from <slang> to <tlang>. Return only the translation, and keep its markup as it is."


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class EngineConfig:
    api_key: str = field(default="", repr=False)
    base_url: str = ""
    model: str = ""
    temperature: float | None = 0.3
    top_p: float | None = 1.0
    sampling: str = "temperature"
    concurrency: int = 3
    request_interval: float = 1.0
    request_timeout: float = 60.0
    max_retries: int = 5
    retry_delay: float = 5.0
    stream: bool = False
    prompt: str | None = None
    extra: dict = field(default_factory=dict)

    def policy(self, max_failures: int, partitions: int | None = None) -> Policy:
        return Policy(self.max_retries, self.retry_delay, self.request_interval, self.concurrency, max_failures, partitions)


@dataclass(frozen=True)
class ColumnGap:
    kind: str = "percentage"
    percentage: int = 10
    space_count: int = 6


@dataclass(frozen=True)
class Config:
    engine: str = "openai"
    source_lang: str = "English"
    target_lang: str = "Chinese"
    prompt: str = PROMPT
    allow_prompt_without_target_lang: bool = False
    cache_enabled: bool = True
    cache_dir: str = "~/.cache/folioflow"
    merge_enabled: bool = True
    merge_length: int = 100_000
    translation_position: str = "below"
    translation_style: str = ""
    column_gap: ColumnGap = ColumnGap()
    original_color: str = ""
    translation_color: str = ""
    target_lang_code: str = ""
    target_direction: str = "auto"
    translate_tags: str = ""
    exclude_translate_tags: str = "sup,code,pre"
    priority_rules: tuple[str, ...] = ()
    ignore_rules: tuple[str, ...] = ()
    reserve_rules: tuple[str, ...] = ()
    filter_rules: tuple[str, ...] = ()
    rule_mode: str = "normal"
    filter_scope: str = "text"
    only_files: str = ""
    exclude_files: str = ""
    metadata_translation: bool = False
    translate_title: bool = False
    custom_title: str = ""
    test_enabled: bool = False
    test_num: int = 10
    retranslate_file: str = ""
    retranslate_start: str = ""
    retranslate_end: str = ""
    glossary_path: str = ""
    glossary: dict[str, str] = field(default_factory=dict)
    input_encoding: str = ""
    ebook_convert_path: str = ""
    max_error_count: int = 10
    skip_failed: bool = False
    log_file: str = ""
    engines: dict[str, EngineConfig] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, told: dict) -> Config:
        """Settings as a JSON object has them. Unknown settings are passed over, unknown ones of an engine raise; flat engines give way to nested ones."""
        told = dict(told)
        nested = dict(told.pop("engines", {}) or {})
        for name in FLAT_ENGINES:
            if name in told:
                nested.setdefault(name, told[name])
        known = {f.name for f in dataclasses.fields(cls)}
        kept = {k: tuple(v) if isinstance(v, list) else v for k, v in told.items() if k in known}
        if isinstance(kept.get("column_gap"), dict):
            gap = dict(kept["column_gap"])
            gap["kind"] = gap.pop("_type", "percentage")
            kept["column_gap"] = ColumnGap(**gap)
        return cls(**kept, engines={k: _engine(k, v) for k, v in nested.items()})

    @classmethod
    def load(cls, path: str | None = None) -> Config:
        """From a file, else from config.json here, else the defaults; `~` stands for the home folder."""
        if path is None:
            path = "config.json" if os.path.exists("config.json") else None
        told = {}
        if path is not None:
            with open(path, encoding="utf-8") as f:
                told = json.load(f)
        config = cls.from_dict(told)
        return dataclasses.replace(config, **{k: os.path.expanduser(getattr(config, k)) for k in ("cache_dir", "glossary_path", "log_file", "ebook_convert_path")})

    def override(self, **given) -> Config:
        """With settings of a call over these; None leaves one as it is. Tests go on after failures."""
        config = dataclasses.replace(self, **{k: v for k, v in given.items() if v is not None})
        if config.input_encoding:
            known = {e.lower(): e for e in ENCODINGS}
            config = dataclasses.replace(config, input_encoding=known.get(config.input_encoding.lower(), config.input_encoding))
        if config.test_enabled:
            config = dataclasses.replace(config, skip_failed=True)
        file, start, end = (v.strip() for v in (config.retranslate_file, config.retranslate_start, config.retranslate_end))
        if (file or start or end) and not (file and start):
            raise ConfigError("a range to translate again needs a file and a start")
        return config

    def with_concurrency(self, n: int) -> Config:
        """With another number of requests at a time for the chosen engine."""
        return dataclasses.replace(self, engines=self.engines | {self.engine: dataclasses.replace(self.engine_config(), concurrency=n)})

    def engine_config(self, name: str | None = None) -> EngineConfig:
        return self.engines.get(name or self.engine, EngineConfig())

    def effective_prompt(self) -> str:
        own = self.engine_config().prompt
        return self.prompt if own is None else own

    def rules(self) -> markup.Rules:
        return markup.Rules(self.priority_rules, self.ignore_rules, self.reserve_rules, self.exclude_translate_tags, self.translate_tags, self.filter_rules, self.rule_mode, self.filter_scope)

    def look(self, lang: str | None, direction: str | None) -> markup.Look:
        gap = self.column_gap
        return markup.Look(self.translation_position, self.translation_style, self.translation_color, self.original_color, lang, direction, gap.kind, gap.percentage, gap.space_count)

    def key_settings(self, source_md5: str, element_signature: str, pairs: list[tuple[str, str]]) -> dict:
        """The settings that a checkpoint depends on: how text is cut and what is asked of the engine, not how it is placed."""
        e = self.engine_config()
        same = (
            "engine source_lang target_lang translate_tags exclude_translate_tags priority_rules ignore_rules reserve_rules filter_rules rule_mode"
            " filter_scope metadata_translation translate_title target_lang_code input_encoding"
        ).split()
        plain = lambda v: list(v) if isinstance(v, tuple) else v
        return {
            **{k: plain(getattr(self, k)) for k in same},
            **{k: getattr(e, k) for k in ("model", "base_url", "sampling", "temperature", "top_p", "extra")},
            "cache_version": 5, "source_content_md5": source_md5, "element_signature": element_signature,
            "prompt": self.effective_prompt(), "glossary": [list(p) for p in pairs],
        }

    def validate(self) -> Config:
        """Itself, if all settings are possible ones."""

        def need(ok: bool, message: str) -> None:
            if not ok:
                raise ConfigError(message)

        def one_of(name: str, *choices: str) -> None:
            need(getattr(self, name) in choices, f"{name} must be one of {', '.join(choices)}")

        one_of("engine", *ENGINES)
        one_of("translation_position", "below", "above", "left", "right", "only")
        one_of("target_direction", "auto", "ltr", "rtl")
        one_of("rule_mode", "normal", "case", "regex")
        one_of("filter_scope", "text", "html")
        gap = self.column_gap
        need(gap.kind in ("percentage", "space_count"), "column_gap._type must be percentage or space_count")
        need(1 <= gap.percentage <= 100 and gap.space_count > 0, "column_gap needs a percentage of 1 to 100 and some spaces")
        need(self.allow_prompt_without_target_lang or "<tlang>" in self.prompt, "the prompt must contain <tlang>")
        need(not self.target_lang_code or bool(re.fullmatch(r"[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*", self.target_lang_code)), "target_lang_code is no language tag")
        for rule in (*self.priority_rules, *self.ignore_rules, *self.reserve_rules):
            try:
                dom.selector(rule)
            except (ValueError, KeyError) as e:
                raise ConfigError(f"not a selector: {rule}") from e
        if self.rule_mode == "regex":
            for rule in self.filter_rules:
                try:
                    re.compile(rule)
                except re.error as e:
                    raise ConfigError(f"not a regular expression: {rule}") from e
        need(not self.input_encoding or self.input_encoding.lower() in {e.lower() for e in ENCODINGS}, f"input_encoding {self.input_encoding} isn't known")
        need(self.max_error_count > 0, "max_error_count must be over 0")
        for name, e in self.engines.items():
            say = f"engine {name}: "
            need(name in ENGINES, say + "not known")
            need(1 <= e.concurrency <= CONCURRENCY_MOST, say + f"concurrency must be 1 to {CONCURRENCY_MOST}")
            need(e.max_retries > 0, say + "max_retries must be over 0")
            need(e.sampling in ("temperature", "top_p"), say + "sampling must be temperature or top_p")
            need(self.allow_prompt_without_target_lang or e.prompt is None or "<tlang>" in e.prompt, say + "the prompt must contain <tlang>")
            need(math.isfinite(e.request_timeout) and 0 < e.request_timeout <= SECONDS_MOST, say + "request_timeout is out of range")
            for key in ("request_interval", "retry_delay"):
                need(math.isfinite(v := getattr(e, key)) and 0 <= v <= SECONDS_MOST, say + f"{key} is out of range")
            most = 1.0 if name == "claude" else 2.0
            need(e.temperature is None or math.isfinite(e.temperature) and 0 <= e.temperature <= most, say + "temperature is out of range")
            need(e.top_p is None or math.isfinite(e.top_p) and 0 <= e.top_p <= 1, say + "top_p is out of range")
            tokens = e.extra.get("max_tokens")
            need("max_tokens" not in e.extra or type(tokens) is int and tokens > 0, say + "max_tokens must be a whole number over 0")
        return self


def _engine(name: str, told: dict | EngineConfig) -> EngineConfig:
    if isinstance(told, EngineConfig):
        return told
    told = dict(told)
    extra = dict(told.pop("extra", None) or told.pop("extra_body", None) or {})
    told.pop("extra_body", None)
    if "max_tokens" in told:
        if "max_tokens" in extra:
            raise ConfigError(f"engine {name}: max_tokens is given twice")
        extra["max_tokens"] = told.pop("max_tokens")
    unknown = told.keys() - {f.name for f in dataclasses.fields(EngineConfig)}
    if unknown:
        raise ConfigError(f"engine {name}: unknown settings {', '.join(sorted(unknown))}")
    return EngineConfig(**told, extra=extra)
