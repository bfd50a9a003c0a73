"""Markup tokens in text: {{etm_o_N}} opens, {{etm_c_N}} closes, {{etm_n_N}} stands for something opaque.

All but the splitting of long texts are columns, with twins (names in _of) for
use on one text inside the engine operator.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import strip

TOKEN = r"\{\{etm_(o|c|n)_(\d+)\}\}"
ANY_TOKEN = r"\{\{etm_[ocn]_\d+\}\}"
DAMAGED = re.compile(r"\{\{\s*etm\s*_\s*([ocn])\s*_\s*((?:\d\s*)+)\}\}")


def normalize_tokens_of(text: str) -> str:
    """Spaces inside the braces and between the digits of a token go."""
    return DAMAGED.sub(lambda m: "{{etm_" + m[1] + "_" + re.sub(r"[^0-9]", "", m[2]) + "}}", text)


#: The same in Java's regex, with one group around all of it.
DAMAGED_JAVA = r"(?U)(\{\{\s*etm\s*_\s*[ocn]\s*_\s*(?:\d\s*)+\}\})"


def normalized(c: Column) -> Column:
    gaps, found = F.split(c, DAMAGED_JAVA, -1), F.regexp_extract_all(c, F.lit(DAMAGED_JAVA), F.lit(1))
    kind = lambda t: F.regexp_extract(t, r"_?\s*([ocn])\s*_", 1)
    mended = F.transform(found, lambda t: F.concat(F.lit("{{etm_"), kind(t), F.lit("_"), F.regexp_replace(t, "[^0-9]", ""), F.lit("}}")))
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(mended, i), F.lit("")))), "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(" + ANY_TOKEN + ")"), F.lit(1))


def same_tokens(a: Column, b: Column) -> Column:
    """The same tokens, each as often."""
    return F.sort_array(tokens(a)) == F.sort_array(tokens(b))


def well_nested(c: Column) -> Column:
    """Each closing token closes the innermost open one, and none stays open."""
    empty = F.struct(F.array().cast("array<string>").alias("open"), F.lit(True).alias("ok"))

    def step(state: Column, token: Column) -> Column:
        kind, number = F.substring(token, 7, 1), F.regexp_extract(token, r"_(\d+)\}", 1)
        last = F.try_element_at(state["open"], F.lit(-1))
        shorter = F.slice(state["open"], 1, F.greatest(F.size(state["open"]) - 1, F.lit(0)))
        return (
            F.when(kind == "o", F.struct(F.concat(state["open"], F.array(number)).alias("open"), state["ok"].alias("ok")))
            .when(kind == "c", F.struct(shorter.alias("open"), (state["ok"] & last.eqNullSafe(number)).alias("ok")))
            .otherwise(state)
        )

    end = F.aggregate(tokens(c), empty, step)
    return end["ok"] & (F.size(end["open"]) == 0)


def is_valid(original: Column, translated: Column) -> Column:
    """A translation, its tokens normalised, that keeps the original's."""
    return same_tokens(original, translated) & well_nested(translated)


def repaired(original: Column, translated: Column) -> Column:
    """The original's tokens with the whole translation in its first stretch of text; null where that can't be.

    For translations that have lost all tokens of an original that has some.
    """
    plain = strip(translated)
    gaps = F.split(original, ANY_TOKEN, -1)
    first = F.array_position(F.transform(gaps, lambda g: strip(g) != ""), True)
    filled = F.transform(gaps, lambda g, i: F.when(strip(g) == "", g).when(i + 1 == first, plain).otherwise(F.lit("")))
    found = tokens(original)
    out = F.array_join(F.transform(filled, lambda g, i: F.concat(g, F.coalesce(F.get(found, i), F.lit("")))), "")
    usable = (F.size(found) > 0) & (F.size(tokens(translated)) == 0) & (plain != "") & (first > 0)
    return F.when(usable & is_valid(original, out), out)


def accepted(original: Column, translated: Column) -> Column:
    """The translation with its tokens in order, by normalising or repair; null where it broke them."""
    fixed = normalized(translated)
    return F.when(is_valid(original, fixed), fixed).otherwise(repaired(original, fixed))


def _balanced(text: str) -> bool:
    open_: list[str] = []
    for kind, number in re.findall(TOKEN, text):
        if kind == "o":
            open_.append(number)
        elif kind == "c" and (not open_ or open_.pop() != number):
            return False
    return not open_


def is_valid_of(original: str, translated: str) -> bool:
    return sorted(re.findall(ANY_TOKEN, original)) == sorted(re.findall(ANY_TOKEN, translated)) and _balanced(translated)


def accepted_of(original: str, translated: str) -> str | None:
    """The same for one pair, for use inside the engine operator."""
    fixed = normalize_tokens_of(translated)
    if is_valid_of(original, fixed):
        return fixed
    found, plain = re.findall(ANY_TOKEN, original), fixed.strip()
    if not found or re.search(ANY_TOKEN, fixed) or not plain:
        return None
    gaps = re.split(ANY_TOKEN, original)
    first = next((i for i, g in enumerate(gaps) if g.strip()), None)
    if first is None:
        return None
    filled = [g if not g.strip() else plain if i == first else "" for i, g in enumerate(gaps)]
    out = "".join(g + t for g, t in zip(filled, [*found, ""], strict=True))
    return out if is_valid_of(original, out) else None


PROTECTED = re.compile(r"\{\{et[mg]_[^{}]+\}\}")
ENDS = ".!?;。！？；"  # a split may follow these or white space


def split_protected_of(text: str) -> tuple[str, str] | None:
    """Two parts that make up the text, cut near its middle, after a sentence if possible and never inside a token.

    Places are compared by their distance in UTF-8 bytes from the middle character.
    """
    n = len(text)
    if n < 2:
        return None
    at = [0]
    for ch in text:
        at.append(at[-1] + len(ch.encode()))
    inside = {i for m in PROTECTED.finditer(text) for i in range(m.start() + 1, m.end())}
    middle, low, high = at[n // 2], at[n // 4], at[n * 3 // 4]
    ends = [i + 1 for i, ch in enumerate(text) if low < at[i] < high and i not in inside and i + 1 not in inside and (ch.isspace() or ch in ENDS)]
    free = [i for i in range(1, n) if i not in inside]
    for places in (ends, free):
        if places:
            cut = min(places, key=lambda i: (abs(at[i] - middle), i))
            return (text[:cut], text[cut:]) if 0 < cut < n else None
    return None


@F.pandas_udf(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))
def split_protected(texts: pd.Series) -> pd.DataFrame:
    cut = [split_protected_of(t) if isinstance(t, str) else None for t in texts]
    return pd.DataFrame({"left": [c[0] if c else None for c in cut], "right": [c[1] if c else None for c in cut]})
