"""Glossaries: terms become tokens before translation and targets after it."""

from __future__ import annotations

import hashlib
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKUP = re.compile(r"\{\{etm_[ocn]_\d+\}\}")


def parse_glossary(text: str, inline: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(source, target) pairs: groups of lines between blank ones, source then target; the inline map wins; longest sources first."""
    found: dict[str, str] = {}
    for group in re.split(r"\n\s*\n", text.removeprefix("﻿").replace("\r\n", "\n")):
        lines = [x.strip() for x in group.strip().split("\n")]
        if lines[0]:
            found[lines[0]] = lines[1] if len(lines) > 1 and lines[1] else lines[0]
    for source, target in (inline or {}).items():
        if source.strip():
            found[source.strip()] = target.strip()
    return sorted(found.items(), key=lambda p: (-len(p[0]), p[0].encode()))


def read_glossary(spark: SparkSession, path: str, inline: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """A glossary file, from wherever Spark reads; it is a settings file, of driver size."""
    rows = spark.read.text(path, wholetext=True).limit(1).collect()
    return parse_glossary(rows[0].value if rows else "", inline)


class Glossary:
    """Terms with their tokens. `apply` and `restore` are columns, `apply_of` and `restore_of` work on one text."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = list(pairs)
        digest = hashlib.sha256(json.dumps([list(p) for p in self.pairs], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()[:12]
        self.tokens = [f"{{{{etg_{digest}_{i:06d}}}}}" for i in range(len(self.pairs))]
        self.place = {source: i for i, (source, _) in enumerate(self.pairs)}
        self.pattern = re.compile("|".join(self._term(s) for s, _ in self.pairs)) if self.pairs else None

    @staticmethod
    def _term(source: str) -> str:
        """Bounded by ASCII word edges where it begins or ends with an ASCII letter or digit."""
        word = lambda ch: ch.isascii() and ch.isalnum()
        return ("(?<![0-9A-Za-z_])" if word(source[0]) else "") + re.escape(source) + ("(?![0-9A-Za-z_])" if word(source[-1]) else "")

    def apply_of(self, text: str) -> str:
        if self.pattern is None:
            return text
        swap = lambda t: self.pattern.sub(lambda m: self.tokens[self.place[m[0]]], t)
        out, end = [], 0
        for m in MARKUP.finditer(text):
            out += [swap(text[end : m.start()]), m[0]]
            end = m.end()
        return "".join([*out, swap(text[end:])])

    def restore_of(self, protected: str, translated: str) -> str:
        """Tokens as targets again; raises where the translation has not the tokens of the protected text."""
        if "{{etg_" not in protected:
            return translated
        for (_, target), token in zip(self.pairs, self.tokens, strict=True):
            expected = protected.count(token)
            if expected:
                spaced = re.compile(r"\{\{\s*" + re.escape(token[2:-2]) + r"\s*\}\}")
                if len(spaced.findall(translated)) != expected:
                    raise ValueError(f"the translation broke the glossary token {token}")
                translated = spaced.sub(lambda _, t=target: t, translated)
        if "{{etg_" in translated:
            raise ValueError("the translation holds an unknown glossary token")
        return translated

    def apply(self, text: Column) -> Column:
        """One pass over the text, longest term first, outside markup tokens; Arrow batches, as each match looks up its token."""
        one = self.apply_of

        @F.pandas_udf("string")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(one, na_action="ignore")

        return run(text) if self.pairs else text

    def restore(self, protected: Column, translated: Column) -> Column:
        """struct(text, error)."""
        one = self.restore_of

        @F.pandas_udf("struct<text:string,error:string>")
        def run(protected: pd.Series, translated: pd.Series) -> pd.DataFrame:
            out = []
            for p, t in zip(protected, translated, strict=True):
                try:
                    out.append((one(p, t), None) if isinstance(p, str) and isinstance(t, str) else (None, None))
                except ValueError as e:
                    out.append((None, str(e)))
            return pd.DataFrame(out, columns=["text", "error"])

        return run(protected, translated)

    def table(self, spark: SparkSession) -> DataFrame:
        """(idx, source, target, token)."""
        rows = [(i, s, t, k) for i, ((s, t), k) in enumerate(zip(self.pairs, self.tokens, strict=True))]
        return spark.createDataFrame(rows, "idx int, source string, target string, token string")
