"""Paths, file names, titles, languages. Columns unless a name ends in _of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Languages by what their name contains, in the order they are tried.
LANGUAGE_NAMES = [
    ("chinese", "zh"), ("中文", "zh"), ("english", "en"), ("japanese", "ja"), ("日本", "ja"), ("korean", "ko"), ("french", "fr"),
    ("german", "de"), ("spanish", "es"), ("portuguese", "pt"), ("italian", "it"), ("russian", "ru"), ("arabic", "ar"), ("hebrew", "he"),
    ("persian", "fa"), ("urdu", "ur"), ("hindi", "hi"), ("turkish", "tr"), ("dutch", "nl"), ("polish", "pl"), ("ukrainian", "uk"),
    ("vietnamese", "vi"), ("thai", "th"), ("indonesian", "id"), ("malay", "ms"),
]
# Languages written from right to left.
RIGHT_TO_LEFT = ["ar", "fa", "he", "ur", "ps", "sd", "ug", "yi"]
# Names that the text service knows beside two-letter codes.
SERVICE_NAMES = [
    ("chinese", "zh"), ("english", "en"), ("japanese", "ja"), ("korean", "ko"), ("french", "fr"), ("german", "de"), ("spanish", "es"),
    ("portuguese", "pt"), ("italian", "it"), ("russian", "ru"), ("arabic", "ar"), ("dutch", "nl"), ("polish", "pl"), ("turkish", "tr"),
    ("vietnamese", "vi"), ("indonesian", "id"), ("thai", "th"), ("hindi", "hi"), ("ukrainian", "uk"), ("greek", "el"), ("swedish", "sv"),
    ("norwegian", "nb"), ("finnish", "fi"), ("czech", "cs"), ("romanian", "ro"), ("hungarian", "hu"), ("bulgarian", "bg"), ("danish", "da"),
    ("slovak", "sk"), ("slovenian", "sl"), ("lithuanian", "lt"), ("latvian", "lv"), ("estonian", "et"), ("croatian", "hr"), ("serbian", "sr"),
    ("hebrew", "he"), ("persian", "fa"), ("urdu", "ur"), ("bengali", "bn"), ("tamil", "ta"), ("malay", "ms"), ("catalan", "ca"),
    ("welsh", "cy"), ("中文", "zh"), ("英语", "en"), ("日语", "ja"), ("韩语", "ko"),
]
# Device names that no file may have.
DEVICES = ["CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10))]
# Encodings that an input may be said to have.
ENCODINGS = (
    "UTF-8 UTF-16 UTF-32 ASCII Windows-1250 Windows-1251 Windows-1252 Windows-1253 Windows-1254 Windows-1255 Windows-1256 Windows-1257"
    " Windows-1258 ISO-8859-1 ISO-8859-2 ISO-8859-3 ISO-8859-4 ISO-8859-5 ISO-8859-6 ISO-8859-7 ISO-8859-8 ISO-8859-9 ISO-8859-10"
    " ISO-8859-11 ISO-8859-13 ISO-8859-14 ISO-8859-15 ISO-8859-16 CP437 CP720 CP737 CP850 CP852 CP855 CP857 CP858 CP860 CP861 CP862"
    " CP863 CP865 CP866 CP869 KOI8-R KOI8-U Shift-JIS EUC-JP ISO-2022-JP Shift_JIS-2004 EUC-JIS-2004 ISO-2022-JP-2004 GB2312 GBK"
    " GB18030 HKSCS KS-X-1001 EUC-KR ISO-2022-KR"
).split()


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def percent_decoded(c: Column) -> Column:
    """%xx decoded as UTF-8; a plus sign stays one, and a text with a broken escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def resolve_href(base: Column, href: Column) -> Column:
    """The href as seen from the base file: no query, no fragment, dots resolved, never above the root."""
    folder = F.regexp_replace(F.replace(base, F.lit("\\"), F.lit("/")), "[^/]*$", "")
    path = percent_decoded(F.replace(F.regexp_extract(href, r"(?s)^[^?#]*", 0), F.lit("\\"), F.lit("/")))
    parts = F.split(F.concat(folder, F.lit("/"), path), "/")
    step = lambda done, part: F.when(part.isin("", "."), done).when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def names_of(value: str) -> list[str]:
    """A comma-separated list, lower-cased, without blanks."""
    return [x for x in (p.strip().lower() for p in value.split(",")) if x]


def file_selected(href: Column, only: str = "", exclude: str = "") -> Column:
    """The href or its last part is named by `only` (if that names any) and not by `exclude`."""
    whole, last = ascii_lower(href), ascii_lower(base_name(href))
    wanted, unwanted = names_of(only), names_of(exclude)
    chosen = F.lit(True) if not wanted else whole.isin(wanted) | last.isin(wanted)
    return chosen if not unwanted else chosen & ~whole.isin(unwanted) & ~last.isin(unwanted)


def is_content(href: Column, media_type: Column) -> Column:
    """A manifest item that holds text: by media type, or by the ending of its name."""
    kind = ascii_lower(media_type)
    ending = ascii_lower(href).rlike(r"\.(?:xhtml|html|htm|xht|xml)\z")
    return (kind != "application/x-dtbncx+xml") & (F.contains(media_type, F.lit("html")) | media_type.isin("application/xml", "text/xml") | ending)


def language_code(name: Column, explicit: str = "") -> Column:
    """The explicit code, or that of the first known name inside the language's name."""
    if explicit:
        return F.lit(explicit)
    low, out = ascii_lower(name), None
    for part, code in LANGUAGE_NAMES:
        hit = F.contains(low, F.lit(part))
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def direction(code: Column, setting: str = "auto") -> Column:
    if setting != "auto":
        return F.lit(setting)
    return F.when(ascii_lower(F.substring_index(code, "-", 1)).isin(RIGHT_TO_LEFT), "rtl")


def service_language(name: Column) -> Column:
    """Upper-case code of a language named or coded, `auto`, or EN for what isn't known."""
    low = ascii_lower(strip(name))
    code = F.regexp_extract(low, "^[^-_]*", 0)
    worded = F.regexp_replace(low, "[ _-]", "")
    for part, short in SERVICE_NAMES:
        worded = F.replace(worded, F.lit(part), F.lit(short))
    found = F.when(code.rlike("^[a-z]{2}$"), code).otherwise(worded)
    known = sorted({c for _, c in SERVICE_NAMES})
    auto = low.isin("auto", "auto detect", "auto-detect", "auto_detect") | (found == "auto")
    return F.when(auto, "auto").when(found.isin(known), F.upper(found)).otherwise("EN")


def canonical_encoding(name: Column) -> Column:
    """The listed spelling of an encoding's name, or null."""
    known = F.create_map(*(F.lit(x) for e in ENCODINGS for x in (e.lower(), e)))
    return F.try_element_at(known, ascii_lower(name))


def output_filename(title: Column, extension: str) -> Column:
    """A file name from a title: 200 bytes at most, cut between characters, and safe on any system."""
    name = F.regexp_replace(title, r'[\p{Cc}<>:"/\\|?*]', "_")
    name = F.regexp_replace(F.regexp_replace(strip(name), r"^\.+", ""), r"[. ]+\z", "")
    name = F.when(name == "", "book").otherwise(name)
    name = F.when(F.upper(name).isin(DEVICES), F.concat(F.lit("_"), name)).otherwise(name)
    most = max(200 - (len(extension) + 1), 1)
    # bytes up to each character tell how many characters fit
    characters = F.split(name, "")
    fits = F.aggregate(
        characters,
        F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("n")),
        lambda a, ch: F.struct(
            (a["bytes"] + F.octet_length(ch)).alias("bytes"),
            F.when(a["bytes"] + F.octet_length(ch) <= most, a["n"] + F.length(ch)).otherwise(a["n"]).alias("n"),
        ),
    )["n"]
    return F.concat(F.when(F.octet_length(name) <= most, name).otherwise(F.substr(name, F.lit(1), fits)), F.lit("." + extension))


def select_title(original: Column, translated: Column, custom: str = "", translate_title: bool = False, translate_metadata: bool = False, position: str = "below") -> Column:
    """A custom title, else the translation if titles are translated, else both if metadata is, else the original."""
    if custom.strip():
        return F.lit(custom.strip())
    said = F.when(strip(translated) != "", strip(translated))
    if translate_title:
        return F.coalesce(said, original)
    if translate_metadata:
        both = {"only": said}.get(position)
        if both is None:
            both = F.concat(said, F.lit(" "), original) if position in ("above", "left") else F.concat(original, F.lit(" "), said)
        return F.coalesce(both, original)
    return original


def human_size(n: Column) -> Column:
    """Bytes as B, KB or MB, the latter two to one decimal; halves go to the even digit, as in C and Rust, and not up, as in Java."""
    n = n.cast("long")

    def tenths(bits: int) -> Column:
        # of the rest alone, which can't overflow; ten times the whole is even
        rest = n.bitwiseAND(F.lit((1 << bits) - 1)) * 10
        return F.shiftright(rest + F.lit((1 << bits - 1) - 1) + F.shiftright(rest, bits).bitwiseAND(F.lit(1)), bits)

    def shown(bits: int, unit: str) -> Column:
        t = tenths(bits)
        whole = F.shiftright(n, bits) + F.when(t == 10, 1).otherwise(0)
        return F.concat(whole.cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(unit))

    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1048576, shown(10, " KB")).otherwise(shown(20, " MB"))


def endpoint_url(base: Column, suffix: str) -> Column:
    """The service's address: the suffix once, no second /v1, the query kept; null where base is no http address."""
    query = F.regexp_extract(base, r"[?#].*$", 0)
    path = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"/+$", "")
    short = suffix[3:] if suffix.startswith("/v1/") else suffix
    full = F.when(F.endswith(path, F.lit(suffix)), F.regexp_replace(base, r"[?#].*$", "")).when(F.endswith(path, F.lit("/v1")), F.concat(path, F.lit(short))).otherwise(F.concat(path, F.lit(suffix)))
    return F.when(base.rlike(r"(?i)^https?://[^/?#]+"), F.concat(full, query))
