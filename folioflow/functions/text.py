"""Text expressions: white space, noise, filters, escapes. All are Catalyst columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space in Java's regex; it includes U+00A0 and U+3000 but not U+200B or U+FEFF.
SPACE = r"(?U)\s+"

# What makes a text noise, a link, an ISBN, a label or a number.
NOISE = r"""(?U)^[-\d\s.'\\"‘’“”,=~!@#$%^&º*|≈<>?/`—…+:–_(){}\[\]]+\z"""
LINK = r"(?iuU)^(?:https?://|www\.)\S+\z"
ISBN = r"(?iuU)^ISBN(?:-1[03])?\s*:?\s*[0-9X][0-9X\-\s]{8,}\z"
LABEL = r"(?iuU)^(?:Figure|Fig\.?|Table)\s*[:#.]?\s*[A-Z0-9]+(?:[.\-][A-Z0-9]+)*[.:]?\z"
NUMBER = r"(?U)^[\d,.\-+eE\s%]+\z"


#: What normalisation would change: white space other than single blanks inside, and zero-width marks.
UNEVEN = r"[\t-\r\x85\xA0\u1680\u2000-\u200B\u2028\u2029\u202F\u205F\u3000\uFEFF]|  |^ | \z"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def normalize_text(c: Column) -> Column:
    """Zero-width marks dropped, white space collapsed to one space, ends stripped."""
    # most texts have nothing to change, which one plain pattern tells
    one = F.regexp_replace(F.regexp_replace(c, "[\u200b\ufeff]", ""), SPACE, " ")
    return F.when(c.rlike(UNEVEN), F.regexp_replace(one, r"^ | \z", "")).otherwise(c)


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def is_noise(c: Column) -> Column:
    """Only digits, white space and punctuation."""
    return c.rlike(NOISE)


def is_non_translatable(c: Column, stripped: bool = False) -> Column:
    """Empty, a bare link, an ISBN, a figure or table label, or a number. stripped: c has no white space at its ends."""
    v = c if stripped else strip(c)
    return (v == "") | v.rlike(LINK) | v.rlike(ISBN) | v.rlike(LABEL) | (v.rlike("[0-9]") & v.rlike(NUMBER))


def matches_rules(visible: Column, rules: list[str], mode: str = "normal", html: Column | None = None) -> Column:
    """Any user rule in the visible text, or in the html where that is given. Modes: normal (any case), case, regex."""
    out = F.lit(False)
    for rule in rules:
        for where in [visible] if html is None else [visible, html]:
            if mode == "case":
                hit = F.contains(where, F.lit(rule))
            elif mode == "normal":
                hit = where.rlike("(?iu)" + literal(rule))
            elif mode == "regex":
                hit = where.rlike("(?U)" + rule)
            else:
                raise ValueError(f"unknown rule mode {mode!r}")
            out = out | hit
    return out


def literal(text: str) -> str:
    """A Java regex that matches just this text."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-#&~\s])", r"\\\1", text)


def escape_text(c: Column) -> Column:
    """HTML text: & < > as references, line ends as <br>."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r\n", "<br>"), ("\r", "<br>"), ("\n", "<br>")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape_attribute(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def combine(original: Column, translation: Column, position: str) -> Column:
    """Original and translation in one line, in the order of the position."""
    t, o = strip(translation), strip(original)
    if position == "only":
        return t
    return F.concat(t, F.lit(" "), o) if position in ("above", "left") else F.concat(o, F.lit(" "), t)


def first_characters(c: Column, k: int) -> Column:
    return F.substring(c, 1, k)


def last_characters(c: Column, k: int) -> Column:
    return F.when(F.length(c) > k, F.right(c, F.lit(k))).otherwise(c)
