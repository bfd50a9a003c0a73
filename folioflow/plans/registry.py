"""Queries of the library and the SQL that they are held against.

Each query applies an operator to a whole table. Where SQL can't say what the
operator does, there is none, and tests hold the query against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, names, services, text, tokens
from ..operators import checkpoint, markup, packages, packing, review
from ..operators.glossary import Glossary
from ..operators.translate import FunctionEngine, Policy, translate_groups
from .units import ORDER, SPACES, SQL_FIXED, SQL_NOISE, UNITS, paragraphs, sql_normal, sql_strip, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def values(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A literal table, as SQL, so that no Python runs for it."""
    lit = lambda v: "NULL" if v is None else "r'" + v + "'" if isinstance(v, str) and "'" not in v and "\n" not in v else '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({columns})")


def sql_values(rows: list[tuple], columns: str) -> str:
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") AS t({columns})"


# ---- units of text ----------------------------------------------------------


@query(f"WITH {UNITS} SELECT book, page, pos, ord, id, signature, original, ignored FROM units")
def paragraph_scan(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("book", "page", "pos", "ord", "id", "signature", "original", "ignored")


ODD_TEXTS = [(1, "\u00a0 a\u3000b \u200bc "), (2, "\ufeffx\u2003\u2028y"), (3, " \n "), (4, "no change"), (5, ""), (6, "a\tb\x0bc\x85d")]


@query(f"""
WITH t AS (SELECT conv_id AS a, turn AS b, text AS v FROM conversations UNION ALL SELECT doc_id, -1, text FROM documents UNION ALL SELECT a, -2, v FROM {sql_values(ODD_TEXTS, "a, v")})
SELECT a, b, {sql_normal("v")} AS normal, {sql_strip("v")} = '' AS blank, left(v, 7) AS head, right(v, 7) AS tail FROM t""")
def normalize_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("text").alias("v"))
    talk = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("a"), F.col("turn").alias("b"), F.col("text").alias("v"))
    odd = values(spark, ODD_TEXTS, "a, v").select(F.col("a").cast("long"), F.lit(-2).cast("long").alias("b"), "v")
    v = F.col("v")
    return talk.unionByName(docs).unionByName(odd).select("a", "b", text.normalize_text(v).alias("normal"), text.is_blank(v).alias("blank"), text.first_characters(v, 7).alias("head"), text.last_characters(v, 7).alias("tail"))


NOISY = [(-1, "https://a.b/c?d=e"), (-2, "www.x.org/y z"), (-3, "ISBN-13: 978-3-16-148410-0"), (-4, "Figure 3.1"), (-5, "fig. A-2:"), (-6, "12,345.6%"), (-7, "--- * ---"), (-8, "e+E"), (-9, "Table of contents"), (-10, "“1984” – (2)"), (-11, "WWW.Example.COM")]


@query(f"""
WITH {UNITS}, t AS (SELECT ord AS k, original AS v FROM units UNION ALL SELECT k, v FROM {sql_values(NOISY, "k, v")})
SELECT k, {SQL_NOISE.format("v")} AS noise, {SQL_FIXED.format("v")} AS fixed FROM t""")
def noise_flags(spark, sf_dir):
    more = values(spark, NOISY, "k, v").select(F.col("k").cast("long").alias("k"), "v")
    both = paragraphs(spark, sf_dir).select(F.col("ord").alias("k"), F.col("original").alias("v")).unionByName(more)
    return both.select("k", text.is_noise(F.col("v")).alias("noise"), text.is_non_translatable(F.col("v")).alias("fixed"))


def _filtered(mode: str, rules: list[str]):
    def run(spark, sf_dir):
        return paragraphs(spark, sf_dir).select("ord", text.matches_rules(F.col("original"), rules, mode).alias("hit"))

    return run


query(f"WITH {UNITS} SELECT ord, contains(lower(original), 'and the') OR contains(lower(original), '. the') AS hit FROM units", "user_filter_normal")(_filtered("normal", ["AND the", ". The"]))
query(f"WITH {UNITS} SELECT ord, contains(original, 'The ') OR contains(original, 'Über') AS hit FROM units", "user_filter_case")(_filtered("case", ["The ", "Über"]))
query(rf"WITH {UNITS} SELECT ord, regexp_matches(original, '[a-z]{{14,}}') OR regexp_matches(original, '[0-9]{{4}}') AS hit FROM units", "user_filter_regex")(_filtered("regex", ["[a-z]{14,}", "[0-9]{4}"]))


@query(f"""
WITH {UNITS} SELECT ord, replace(replace(replace(original, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped,
  replace(replace(replace(replace(original, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS attribute,
  'U:' || original || ' ' || original AS above, original || ' U:' || original AS below, 'U:' || original AS only FROM units""")
def escape_and_combine(spark, sf_dir):
    o, t = F.col("original"), F.concat(F.lit(" U:"), "original")
    return paragraphs(spark, sf_dir).select("ord", text.escape_text(o).alias("escaped"), text.escape_attribute(o).alias("attribute"), *(text.combine(o, t, p).alias(p) for p in ("above", "below", "only")))


# ---- names ------------------------------------------------------------------

HREFS = [(1, "OEBPS/content.opf", "Text/chapter%201.xhtml?q=1#x"), (2, "a/b/c.opf", "../../../d.html"), (3, "content.opf", "./x//y/../z+1.htm"), (4, "o\\p.opf", "q\\r.xhtml")]
RESOLVED = [(1, "OEBPS/Text/chapter 1.xhtml"), (2, "d.html"), (3, "x/z+1.htm"), (4, "o/q/r.xhtml")]


@query(f"SELECT t.k AS k, t.want AS resolved FROM {sql_values(RESOLVED, 'k, want')}")
def resolve_href(spark, sf_dir):
    return values(spark, HREFS, "k, base, href").select("k", names.resolve_href(F.col("base"), F.col("href")).alias("resolved"))


@query(r"""
SELECT page_id, url, lower(regexp_extract(url, '[^/]*$')) IN ('index.html', '101.html', '12.html') OR contains(url, '/en/') AND FALSE AS chosen,
  regexp_extract(url, '[^/]*$') AS last FROM pages""")
def file_selection(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", "url", names.file_selected(u, only="index.html, 101.HTML,12.html").alias("chosen"), names.base_name(u).alias("last"))


LANGS = [(1, "Chinese (Simplified)"), (2, "Arabic"), (3, "日本語"), (4, "Brazilian Portuguese"), (5, "Klingon"), (6, "zh-CN"), (7, "auto detect"), (8, "Norwegian"), (9, "中文"), (10, "fr"), (11, "日本語 "), (12, "Hebrew")]
LANG_WANT = [(1, "zh", None, "EN"), (2, "ar", "rtl", "AR"), (3, "ja", None, "EN"), (4, "pt", None, "EN"), (5, None, None, "EN"), (6, None, None, "ZH"), (7, None, None, "auto"), (8, None, None, "NB"), (9, "zh", None, "ZH"), (10, None, None, "FR"), (11, "ja", None, "EN"), (12, "he", "rtl", "HE")]


@query(f"SELECT k, code, dir, service FROM {sql_values(LANG_WANT, 'k, code, dir, service')}")
def language_code(spark, sf_dir):
    t = values(spark, LANGS, "k, name").withColumn("code", names.language_code(F.col("name")))
    return t.select("k", "code", names.direction(F.col("code")).alias("dir"), names.service_language(F.col("name")).alias("service"))


@query(f"""
WITH t AS (SELECT doc_id AS k, text AS title FROM documents UNION ALL SELECT page_id + 10000000, url FROM pages
  UNION ALL SELECT k, v FROM {sql_values([(-1, "CON"), (-2, "a/b:*?"), (-3, "...Title. ."), (-4, " \t "), (-5, "lpt9")], "k, v")}),
a AS (SELECT k, regexp_replace(regexp_replace({sql_strip("regexp_replace(title, '[\\x00-\\x1F\\x7F-\\x{9F}<>:\"/\\\\|?*]', '_', 'g')")}, '^\\.+', ''), '[. ]+$', '') AS n FROM t),
b AS (SELECT k, CASE WHEN n = '' THEN 'book' WHEN regexp_matches(upper(n), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || n ELSE n END AS n FROM a)
SELECT k, (CASE WHEN strlen(n) <= 195 THEN n ELSE left(n, (SELECT max(i) FROM range(1, least(length(n), 195) + 1) r(i) WHERE strlen(left(n, i)) <= 195)::INT) END) || '.epub' AS filename FROM b""")
def output_filename(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"), F.col("text").alias("title"))
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") + 10_000_000).alias("k"), F.col("url").alias("title"))
    more = values(spark, [(-1, "CON"), (-2, "a/b:*?"), (-3, "...Title. ."), (-4, " \t "), (-5, "lpt9")], "k, title").select(F.col("k").cast("long").alias("k"), "title")
    return docs.unionByName(pages).unionByName(more).select("k", names.output_filename(F.col("title"), "epub").alias("filename"))


@query("""
SELECT page_id, coalesce(said, url) AS titled, coalesce(url || ' ' || said, url) AS below, coalesce(said || ' ' || url, url) AS above, 'Mine' AS custom, url AS plain,
  CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS size
FROM (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN upper(url) END AS said, length(html) * (1 + page_id % 900) AS n FROM pages)""")
def select_title(spark, sf_dir):
    n = F.length("html") * (1 + F.col("page_id") % 900)
    t = table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 1, F.concat(F.lit(" "), F.upper("url"))).when(F.col("page_id") % 3 == 2, " ").alias("said"), n.alias("n"))
    u, s = F.col("url"), F.col("said")
    return t.select(
        "page_id", names.select_title(u, s, translate_title=True).alias("titled"), names.select_title(u, s, translate_metadata=True).alias("below"),
        names.select_title(u, s, translate_metadata=True, position="above").alias("above"), names.select_title(u, s, custom=" Mine ").alias("custom"), names.select_title(u, s).alias("plain"), names.human_size(F.col("n")).alias("size"),
    )


ENDPOINTS = [(1, "https://h/v1"), (2, "https://h/v1/chat/completions"), (3, "http://h:8/x/?k=1"), (4, "ftp://h"), (5, "https://h")]
ENDPOINT_WANT = [(1, "https://h/v1/chat/completions"), (2, "https://h/v1/chat/completions"), (3, "http://h:8/x/v1/chat/completions?k=1"), (4, None), (5, "https://h/v1/chat/completions")]


@query(f"SELECT k, url FROM {sql_values(ENDPOINT_WANT, 'k, url')}")
def endpoint_url(spark, sf_dir):
    return values(spark, ENDPOINTS, "k, base").select("k", names.endpoint_url(F.col("base"), "/v1/chat/completions").alias("url"))


ENCODINGS = [(1, "utf-8", "UTF-8"), (2, "gb18030", "GB18030"), (3, "shift_jis-2004", "Shift_JIS-2004"), (4, "latin-9", None)]


@query(f"SELECT k, want AS encoding FROM {sql_values(ENCODINGS, 'k, v, want')}")
def canonical_encoding(spark, sf_dir):
    return values(spark, ENCODINGS, "k, v, want").select("k", names.canonical_encoding(F.col("v")).alias("encoding"))


# ---- packages ---------------------------------------------------------------


def _package(spark, sf_dir):
    """Pages as a package for each of seven books: odd ids name a file twice, even ids are in the spine, some spine entries have no item."""
    pages = table(spark, sf_dir, "pages")
    book = (F.col("page_id") % 7).cast("string")
    items = pages.select(book.alias("book"), F.col("page_id").alias("pos"), F.concat(F.lit("i"), "page_id").alias("id"), F.concat(F.lit("p"), F.expr("page_id div 2 * 2"), F.lit(".xhtml")).alias("href"), F.when(F.col("page_id") % 5 == 0, "image/png").otherwise("application/xhtml+xml").alias("media_type"), F.array().cast("array<string>").alias("properties"))
    spine = pages.filter("page_id % 2 = 0 or page_id % 9 = 0").select(book.alias("book"), (1000000 - F.col("page_id")).alias("pos"), F.concat(F.lit("i"), F.when(F.col("page_id") % 8 == 0, -F.col("page_id")).otherwise(F.col("page_id"))).alias("idref"))
    return items, spine


PACKAGE_SQL = """
items AS (SELECT (page_id % 7)::VARCHAR AS book, page_id AS pos, 'i' || page_id AS id, 'p' || (page_id // 2 * 2) || '.xhtml' AS href, CASE WHEN page_id % 5 = 0 THEN 'image/png' ELSE 'application/xhtml+xml' END AS media_type FROM pages),
spine AS (SELECT (page_id % 7)::VARCHAR AS book, 1000000 - page_id AS pos, 'i' || CASE WHEN page_id % 8 = 0 THEN -page_id ELSE page_id END AS idref FROM pages WHERE page_id % 2 = 0 OR page_id % 9 = 0)"""


@query(f"""
WITH {PACKAGE_SQL},
first AS (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY book, href ORDER BY pos) = 1),
inspine AS (SELECT i.book, i.href, min(s.pos) AS nth FROM spine s JOIN items i ON s.book = i.book AND s.idref = i.id GROUP BY ALL),
seen AS (SELECT f.book, f.id, f.href, 0 AS part, nth FROM first f JOIN inspine USING (book, href)),
rest AS (SELECT book, id, href, 1 AS part, 0 AS nth FROM items WHERE NOT EXISTS (SELECT 1 FROM seen WHERE seen.book = items.book AND seen.href = items.href))
SELECT book, row_number() OVER (PARTITION BY book ORDER BY part, nth, href, id) - 1 AS place, id, href FROM (FROM seen UNION ALL FROM rest)""")
def spine_order(spark, sf_dir):
    items, spine = _package(spark, sf_dir)
    return packages.content_order(items, spine, F.lit(False)).select("book", F.col("place").cast("long").alias("place"), "id", "href")


@query("""
WITH m AS (SELECT (page_id % 3)::VARCHAR AS book, page_id AS idx, CASE WHEN page_id % 11 = 3 THEN 'same' ELSE url END AS name, CASE WHEN page_id % 50 = 7 THEN 300000000 ELSE length(html) * 30000 END AS size, CASE WHEN page_id % 13 = 0 THEN 5 ELSE length(html) * 10000 END AS csize FROM pages),
w AS (SELECT *, sum(size) OVER (PARTITION BY book ORDER BY idx) AS running, row_number() OVER (PARTITION BY book, name ORDER BY idx) AS nth FROM m)
SELECT * FROM (SELECT book, idx, name, CASE WHEN nth > 1 THEN 'repeated name' WHEN size > 268435456 THEN 'member too large' WHEN running > 4294967296 THEN 'archive too large' WHEN size > 10485760 AND csize > 0 AND size // csize > 1000 THEN 'suspicious ratio' END AS violation FROM w) WHERE violation IS NOT NULL""")
def archive_checks(spark, sf_dir):
    p = F.col("page_id")
    members = table(spark, sf_dir, "pages").select((p % 3).cast("string").alias("book"), p.alias("idx"), F.when(p % 11 == 3, "same").otherwise(F.col("url")).alias("name"), F.when(p % 50 == 7, F.lit(300000000).cast("long")).otherwise(F.length("html").cast("long") * 30000).alias("size"), F.when(p % 13 == 0, F.lit(5).cast("long")).otherwise(F.length("html").cast("long") * 10000).alias("csize"))
    return packages.archive_violations(members)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS occurrence FROM conversations")
def occurrence_number(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", "role", packing.occurrence_number(t, ["conv_id", "role"], ["turn"]).cast("long").alias("occurrence"))


@query(r"""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1)) AS raw, unnest(range(0, len(regexp_extract_all(regexp_extract(html, '<nav>(.*?)</nav>', 1), '<a href="[^"]*">([^<]*)</a>', 1)))) AS k FROM pages)
SELECT page_id::VARCHAR AS page, k::VARCHAR AS key, replace(replace(replace(replace(trim(raw), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS label FROM a WHERE trim(raw) <> ''""")
def nav_entries(spark, sf_dir):
    return markup.extract_pages(_pages(spark, sf_dir), kind="toc").select("page", "key", F.col("original").alias("label"))


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.lit("book").alias("book"), F.col("page_id").cast("string").alias("page"), "html")


@query()
def body_candidates(spark, sf_dir):
    return markup.keyed_elements(markup.extract_pages(_pages(spark, sf_dir))).select("page", F.col("key").cast("int").alias("key"), "original", "ignored", "id", "signature")


@query()
def inject_pages(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    said = markup.keyed_elements(markup.extract_pages(pages)).filter("not ignored").select("book", "page", "id", F.col("original").alias("translation"))
    return markup.inject_pages(pages, said, look=markup.Look(position="below", lang="ar", direction="rtl"))


# ---- packing ----------------------------------------------------------------

LIMIT = 2000


@query(f"""
WITH RECURSIVE {UNITS},
sized AS (SELECT book, page, ord, length(original) AS n, row_number() OVER (PARTITION BY page ORDER BY ord) AS i FROM units),
packed AS (
  SELECT book, page, ord, i, n, n AS held, ord AS start FROM sized WHERE i = 1
  UNION ALL
  SELECT s.book, s.page, s.ord, s.i, s.n, CASE WHEN p.held + s.n > {LIMIT} THEN s.n ELSE p.held + s.n END, CASE WHEN p.held + s.n > {LIMIT} THEN s.ord ELSE p.start END
  FROM packed p JOIN sized s ON s.page = p.page AND s.i = p.i + 1
)
SELECT book, page, start AS group_start, count(*) AS n_units, sum(n)::BIGINT AS chars FROM packed GROUP BY ALL""")
def merge_groups(spark, sf_dir):
    packed = packing.merge_groups(paragraphs(spark, sf_dir), LIMIT, pages_once=True)
    return packing.group_rows(packed).drop("members")


@query(f"""
WITH RECURSIVE {UNITS},
sized AS (SELECT book, page, ord, length(original) AS n, row_number() OVER (PARTITION BY book ORDER BY ord) AS i FROM units WHERE NOT ignored AND ord % 3 <> 0),
packed AS (
  SELECT book, page, ord, i, n, n AS held, ord AS start FROM sized WHERE i = 1
  UNION ALL
  SELECT s.book, s.page, s.ord, s.i, s.n, CASE WHEN s.page <> p.page OR p.held + s.n > 700 THEN s.n ELSE p.held + s.n END, CASE WHEN s.page <> p.page OR p.held + s.n > 700 THEN s.ord ELSE p.start END
  FROM packed p JOIN sized s ON s.book = p.book AND s.i = p.i + 1
)
SELECT book, page, start AS group_start, count(*) AS n_units, sum(n)::BIGINT AS chars FROM packed GROUP BY ALL""")
def merge_pending(spark, sf_dir):
    rows = paragraphs(spark, sf_dir).filter("not ignored and ord % 3 <> 0")
    return packing.group_rows(packing.merge_groups(rows, 700)).drop("members")


@query(f"""
WITH {UNITS}, s AS (SELECT book, min(ord) AS a FROM units WHERE contains(original, 'the') GROUP BY book),
f AS (SELECT units.*, a FROM units JOIN s USING (book) WHERE ord >= a), e AS (SELECT book, min(ord) AS b FROM f WHERE contains(original, 'thonth') GROUP BY book)
SELECT f.book, ord, id FROM f LEFT JOIN e USING (book) WHERE b IS NULL OR ord <= b""")
def retranslate_range(spark, sf_dir):
    return packing.range_selection(paragraphs(spark, sf_dir), "the", "thonth").select("book", "ord", "id")


@query("""
WITH o AS (SELECT user_id, event_id, event_type <> 'purchase' AND value > 20 AS ok FROM events),
g AS (SELECT *, sum(ok::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM o),
r AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id, island ORDER BY event_id)::INT AS failures FROM g)
SELECT user_id, event_id, ok, failures, max(failures) OVER (PARTITION BY user_id ORDER BY event_id) >= 3 AS tripped FROM r""")
def circuit_breaker(spark, sf_dir):
    ok = (F.col("event_type") != "purchase") & (F.col("value") > 20)
    return packing.consecutive_failures(table(spark, sf_dir, "events").select("user_id", "event_id", ok.alias("ok")), ["user_id"], ["event_id"], 3)


# ---- checkpoint -------------------------------------------------------------


def _rows(spark, sf_dir):
    """A checkpoint of all units, a third of them done."""
    u = paragraphs(spark, sf_dir).withColumn("cache_key", F.lit("k"))
    done = F.col("ord") % 3 == 0
    rows = checkpoint.as_rows(u)
    return rows.withColumns({"translation": F.when(done, F.concat(F.lit("U:"), "original")), "engine_name": F.when(done, "e1"), "target_lang": F.when(done, "x")})


ROWS = f"""{UNITS}, ck AS (SELECT 'k' AS cache_key, ord, id, signature AS md5, raw, original, ignored, kind AS attributes, page,
  CASE WHEN ord % 3 = 0 THEN 'U:' || original END AS translation, CASE WHEN ord % 3 = 0 THEN 'e1' END AS engine_name, CASE WHEN ord % 3 = 0 THEN 'x' END AS target_lang FROM units)"""


def _extracted(spark, sf_dir):
    """Units as read again: some gone, some changed, some new."""
    u = paragraphs(spark, sf_dir).filter("ord % 10 <> 1").withColumn("cache_key", F.lit("k"))
    changed = u.withColumns({"original": F.when(F.col("ord") % 4 == 0, F.concat("original", F.lit("!"))).otherwise(F.col("original")), "ignored": F.col("ord") % 7 == 0, "id": F.when(F.col("ord") % 6 == 0, F.concat(F.lit("new"), "id")).otherwise(F.col("id"))})
    return checkpoint.as_rows(changed)


@query(f"""
WITH {ROWS},
nw AS (SELECT CASE WHEN ord % 6 = 0 THEN 'new' || id ELSE id END AS id, ord, md5, raw, CASE WHEN ord % 4 = 0 THEN original || '!' ELSE original END AS original, ord % 7 = 0 AS ignored, attributes, page FROM ck WHERE ord % 10 <> 1),
fresh AS (SELECT *, (SELECT max(ord) FROM ck) + row_number() OVER (ORDER BY ord, id) AS place FROM nw WHERE id NOT IN (SELECT id FROM ck))
SELECT 'k' AS cache_key, coalesce(ck.ord, fresh.place) AS ord, coalesce(ck.id, nw.id) AS id, CASE WHEN nw.id IS NULL THEN ck.original ELSE nw.original END AS original,
  CASE WHEN nw.id IS NULL THEN ck.ignored ELSE nw.ignored END AS ignored, ck.translation, ck.engine_name, ck.target_lang
FROM ck FULL JOIN nw ON ck.id = nw.id LEFT JOIN fresh ON fresh.id = nw.id""")
def cache_upsert(spark, sf_dir):
    return checkpoint.upsert(_rows(spark, sf_dir), _extracted(spark, sf_dir)).select("cache_key", "ord", "id", "original", "ignored", "translation", "engine_name", "target_lang")


@query(f"WITH {ROWS} SELECT id, CASE WHEN ord % 5 = 0 THEN 'T' || original ELSE translation END AS translation, CASE WHEN ord % 5 = 0 THEN 'e2' ELSE engine_name END AS engine_name, CASE WHEN ord % 5 = 0 THEN 'y' ELSE target_lang END AS target_lang FROM ck")
def cache_update(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    done = rows.filter("ord % 5 = 0").select("id", F.concat(F.lit("T"), "original").alias("translation"), F.lit("e2").alias("engine_name"), F.lit("y").alias("target_lang"))
    return checkpoint.update_translations(rows, done).select("id", "translation", "engine_name", "target_lang")


@query(f"WITH {ROWS} SELECT id, CASE WHEN ord % 2 = 0 THEN NULL ELSE translation END AS translation, CASE WHEN ord % 2 = 0 THEN NULL ELSE engine_name END AS engine_name FROM ck")
def cache_clear(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return checkpoint.clear(rows, rows.filter("ord % 2 = 0").select("id")).select("id", "translation", "engine_name")


@query(f"WITH {ROWS} SELECT id, CASE WHEN ignored THEN translation END AS translation FROM ck")
def cache_clear_all(spark, sf_dir):
    return checkpoint.clear(_rows(spark, sf_dir)).select("id", "translation")


@query(f"""
WITH {ROWS}, d AS (SELECT ck.*, l.quality, l.toxic FROM ck LEFT JOIN labels l ON l.doc_id = ck.ord // {ORDER})
SELECT id, CASE WHEN quality IS NULL THEN ignored WHEN quality = 0 THEN FALSE ELSE toxic = 1 END AS ignored,
  CASE WHEN quality IS NULL THEN translation WHEN quality = 0 OR toxic = 1 THEN NULL WHEN ord % 2 = 0 THEN 'R' || original ELSE translation END AS translation,
  CASE WHEN quality IS NULL THEN engine_name WHEN quality = 0 OR toxic = 1 THEN NULL WHEN ord % 2 = 0 THEN 'person' ELSE engine_name END AS engine_name FROM d""")
def apply_review(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    labels = table(spark, sf_dir, "labels")
    d = rows.withColumn("doc_id", F.expr(f"ord div {ORDER}")).join(labels, "doc_id").select("id", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("R"), "original")).alias("translation"), (F.col("toxic") == 1).alias("ignored"), (F.col("quality") == 0).alias("retranslate"))
    return checkpoint.apply_review(rows, d, "person", "z").select("id", "ignored", "translation", "engine_name")


@query(f"WITH {ROWS} SELECT count(*) FILTER (NOT ignored AND translation IS NOT NULL) AS translated, count(*) FILTER (NOT ignored) AS total FROM ck")
def cache_counts(spark, sf_dir):
    return checkpoint.counts(_rows(spark, sf_dir))


@query(f"WITH {ROWS} SELECT ord, id FROM ck WHERE NOT ignored AND translation IS NULL ORDER BY ord LIMIT 10")
def pending_top_n(spark, sf_dir):
    return checkpoint.first_pending(_rows(spark, sf_dir), 10).select("ord", "id")


@query("SELECT * FROM (SELECT 'c' || conv_id AS cache_key, role AS key, max_by(text, turn) AS value FROM conversations GROUP BY ALL)")
def info_upsert(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id").alias("cache_key"), F.col("role").alias("key"), F.col("text").alias("value"), "turn")
    last = t.groupBy("cache_key", "key").agg(F.max("turn").alias("turn"))
    new = t.join(last, ["cache_key", "key", "turn"]).drop("turn")
    old = t.groupBy("cache_key", "key").agg(F.min_by("value", "turn").alias("value"))
    return checkpoint.set_info(old, new)


@query(f"""
WITH {UNITS} SELECT book, md5('[' || string_agg('["' || id || '","' || kind || '","' || page || '","' || signature || '"]', ',' ORDER BY ord) || ']') AS element_signature FROM units GROUP BY book""")
def element_signature(spark, sf_dir):
    return keys.element_signature(paragraphs(spark, sf_dir), ["book"], ["ord"])


# ---- review -----------------------------------------------------------------


@query(f"""
WITH {ROWS}, e AS (SELECT * FROM ck), c AS (SELECT * FROM ck WHERE ord % 4 <> 1)
SELECT e.id, e.attributes AS kind, e.page, e.original, c.translation, coalesce(c.ignored, e.ignored) AS ignored, 'keep' AS action, e.md5 AS signature FROM e LEFT JOIN c ON e.id = c.id""")
def review_export(spark, sf_dir):
    units = paragraphs(spark, sf_dir)
    return review.export_rows(units, _rows(spark, sf_dir).filter("ord % 4 <> 1")).select("id", "kind", "page", "original", "translation", "ignored", "action", "signature")


@query(f"""
WITH {UNITS},
r AS (SELECT CASE WHEN ord % 11 = 0 THEN 'u' || id ELSE id END AS id, CASE WHEN ord % 13 = 0 THEN original || '?' ELSE original END AS original, signature,
  CASE WHEN ord % 17 = 0 THEN 'drop' WHEN ord % 5 = 0 THEN 'retranslate' ELSE 'keep' END AS action, ord % 19 = 0 AS ignored, CASE WHEN ord % 23 = 0 THEN ' ' WHEN ord % 3 = 0 THEN original END AS translation FROM units
  UNION ALL SELECT id, original, signature, 'keep', FALSE, NULL FROM units WHERE ord % 29 = 0),
c AS (SELECT r.*, u.id IS NULL AS unknown, u.original AS o2, count(*) OVER (PARTITION BY r.id) AS n FROM r LEFT JOIN units u ON r.id = u.id)
SELECT id, violation, count(*) AS n FROM (SELECT id, CASE WHEN n > 1 THEN 'repeated id' WHEN unknown THEN 'unknown id' WHEN original <> o2 THEN 'stale' WHEN action NOT IN ('keep', 'retranslate') THEN 'unknown action'
  WHEN action = 'retranslate' AND ignored THEN 'retranslate and ignored' WHEN action = 'keep' AND NOT ignored AND trim(translation) = '' THEN 'empty translation' END AS violation FROM c) WHERE violation IS NOT NULL GROUP BY ALL""")
def review_violations(spark, sf_dir):
    u = paragraphs(spark, sf_dir)
    o = F.col("ord")
    first = u.select(
        F.when(o % 11 == 0, F.concat(F.lit("u"), "id")).otherwise(F.col("id")).alias("id"), "kind", F.when(o % 13 == 0, F.concat("original", F.lit("?"))).otherwise(F.col("original")).alias("original"), "signature",
        F.when(o % 17 == 0, "drop").when(o % 5 == 0, "retranslate").otherwise("keep").alias("action"), (o % 19 == 0).alias("ignored"), F.when(o % 23 == 0, " ").when(o % 3 == 0, F.col("original")).alias("translation"),
    )
    again = u.filter("ord % 29 = 0").select("id", "kind", "original", "signature", F.lit("keep").alias("action"), F.lit(False).alias("ignored"), F.lit(None).cast("string").alias("translation"))
    return review.violations(first.unionByName(again), u).groupBy("id", "violation").agg(F.count("*").alias("n"))


@query(f"""
WITH {UNITS}, u AS (SELECT * FROM units WHERE page LIKE '%7.xhtml'), s AS (SELECT book, min(ord) AS a FROM u WHERE contains(original, 'an') GROUP BY book)
SELECT u.book, ord FROM u JOIN s USING (book) WHERE page = 'text/doc7.xhtml' AND ord >= (SELECT min(ord) FROM u u2 WHERE page = 'text/doc7.xhtml' AND contains(original, 'an'))""")
def retranslate_page(spark, sf_dir):
    return packing.range_selection(paragraphs(spark, sf_dir), "an", page="doc7.xhtml").select("book", "ord")


# ---- tokens and glossary ----------------------------------------------------

TERMS = [("the end", "das Ende"), ("the", "der"), ("and", "und"), ("of", "von"), ("Thin", "dünn")]
TERM_ORDER = sorted(TERMS, key=lambda p: (-len(p[0]), p[0].encode()))
GLOSSARY = Glossary(TERM_ORDER)


def _sql_apply(c: str) -> str:
    for (source, _), token in zip(GLOSSARY.pairs, GLOSSARY.tokens, strict=True):
        c = f"regexp_replace({c}, '\\b{source}\\b', '{token}', 'g')"
    return c


def _sql_restore(c: str) -> str:
    for (_, target), token in zip(GLOSSARY.pairs, GLOSSARY.tokens, strict=True):
        c = f"replace({c}, '{token}', '{target}')"
    return c


@query(f"WITH {UNITS} SELECT ord, {_sql_apply('original')} AS protected FROM units")
def glossary_apply(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("ord", GLOSSARY.apply(F.col("original")).alias("protected"))


@query(f"WITH {UNITS} SELECT ord, {_sql_restore('upper(' + _sql_apply('original') + ')').replace('upper(', '(')} AS text, NULL::VARCHAR AS error FROM units")
def glossary_restore(spark, sf_dir):
    p = GLOSSARY.apply(F.col("original"))
    return paragraphs(spark, sf_dir).select("ord", p.alias("p")).select("ord", GLOSSARY.restore(F.col("p"), F.col("p")).alias("r")).select("ord", "r.text", "r.error")


TOKEN_CASES = [
    (1, "a {{etm_o_00000}}b{{etm_c_00000}} c", "x {{etm_o_00000}}y{{etm_c_00000}} z"), (2, "{{etm_n_00000}}a", "{{ etm_n_0 0000 }}b"), (3, "{{etm_o_00000}}a{{etm_c_00000}}b", "plain"),
    (4, "{{etm_o_00000}}a{{etm_c_00000}}", "{{etm_c_00000}}x{{etm_o_00000}}"), (5, "{{etm_o_00000}}{{etm_o_00001}}a{{etm_c_00001}}{{etm_c_00000}}", "{{etm_o_00000}}{{etm_o_00001}}x{{etm_c_00000}}{{etm_c_00001}}"),
    (6, "{{etm_n_00000}}", "words"), (7, "no tokens", "keine"), (8, "a{{etm_n_00000}}b", "{{etm_n_00001}}"), (9, "a{{etm_n_00000}}", " "),
]
TOKEN_WANT = [(1, True, "x {{etm_o_00000}}y{{etm_c_00000}} z"), (2, False, "{{etm_n_00000}}b"), (3, False, "{{etm_o_00000}}plain{{etm_c_00000}}"), (4, False, None), (5, False, None), (6, False, None), (7, True, "keine"), (8, False, None), (9, False, None)]


@query(f"SELECT k, valid = 1 AS valid, accepted FROM {sql_values([(k, int(v), a) for k, v, a in TOKEN_WANT], 'k, valid, accepted')}")
def token_validate(spark, sf_dir):
    t = values(spark, TOKEN_CASES, "k, o, t")
    return t.select("k", tokens.is_valid(F.col("o"), F.col("t")).alias("valid"), tokens.accepted(F.col("o"), F.col("t")).alias("accepted"))


@query()
def split_protected(spark, sf_dir):
    s = paragraphs(spark, sf_dir).select("ord", "original", tokens.split_protected(GLOSSARY.apply(F.col("original"))).alias("s"))
    return s.select("ord", "s.left", "s.right")


# ---- services ---------------------------------------------------------------

ERRORS = [(1, 429, "x"), (2, 401, "x"), (3, None, "This model's Maximum Context Length is 8"), (4, None, "too many tokens"), (5, None, "finish_reason=length"), (6, None, "Incorrect API key"), (7, None, "Too many requests"), (8, None, "returned empty"), (9, 500, "HTTP 500: oops"), (10, None, "HTTP 403")]
ERROR_WANT = ["RateLimit", "Permanent", "ContextOverflow", "ContextOverflow", "Truncated", "Permanent", "RateLimit", "Empty", "Transient", "Permanent"]


@query(f"SELECT k, want AS kind FROM {sql_values([(i + 1, w) for i, w in enumerate(ERROR_WANT)], 'k, want')}")
def error_classification(spark, sf_dir):
    return values(spark, ERRORS, "k, status, message").select("k", services.classify_error(F.col("status"), F.col("message")).alias("kind"))


@query("""
WITH e AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'RateLimit' WHEN 'click' THEN 'Empty' WHEN 'view' THEN 'Truncated' ELSE 'Transient' END AS kind, (event_id % 5 + 1)::INT AS attempt FROM events)
SELECT event_id, greatest(1, CASE kind WHEN 'Truncated' THEN 1 WHEN 'Empty' THEN 2 ELSE 5 END)::INT AS attempts, (CASE kind WHEN 'RateLimit' THEN 10.0 WHEN 'Empty' THEN 2.0 ELSE 5.0 END * attempt)::DOUBLE AS wait FROM e""")
def retry_schedule(spark, sf_dir):
    kind = F.when(F.col("event_type") == "purchase", "RateLimit").when(F.col("event_type") == "click", "Empty").when(F.col("event_type") == "view", "Truncated").otherwise("Transient")
    e = table(spark, sf_dir, "events").select("event_id", kind.alias("kind"), (F.col("event_id") % 5 + 1).cast("int").alias("attempt"))
    return e.select("event_id", services.attempts(F.col("kind"), F.lit(5)).cast("int").alias("attempts"), services.base_wait(F.col("kind"), F.lit(5.0), F.col("attempt")).cast("double").alias("wait"))


WAITS = [(1, "3"), (2, "-1"), (3, "NaN"), (4, "inf"), (5, "1e300"), (6, "10000"), (7, "Fri, 31 Dec 1999 23:59:59 GMT"), (8, "Thu, 01 Jan 1970 00:01:40 GMT"), (9, "soon"), (10, "1.5")]
WAIT_WANT = [(1, 3.0), (2, None), (3, None), (4, None), (5, None), (6, 300.0), (7, 300.0), (8, 90.0), (9, None), (10, 1.5)]


@query(f"SELECT k, want::DOUBLE AS wait FROM {sql_values(WAIT_WANT, 'k, want')}")
def retry_after(spark, sf_dir):
    return values(spark, WAITS, "k, v").select("k", services.retry_after(F.col("v"), F.lit(10.0)).alias("wait"))


@query("""
SELECT conv_id, turn, CASE turn % 4 WHEN 3 THEN NULL ELSE text END AS text, CASE turn % 4 WHEN 3 THEN 'finish_reason=length' END AS error FROM conversations""")
def response_parse(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").withColumn("turn4", F.col("turn") % 4)
    finish = F.when(F.col("turn4") == 3, "length").otherwise("stop")
    choice = F.when(F.col("turn4") == 1, F.struct(F.lit(None).cast("string").alias("text"), finish.alias("finish_reason"), F.struct(F.col("text").alias("content")).alias("message"))).otherwise(F.struct(F.col("text"), finish.alias("finish_reason"), F.struct(F.lit(None).cast("string").alias("content")).alias("message")))
    body = F.to_json(F.struct(F.array(choice).alias("choices")))
    return t.select("conv_id", "turn", services.response_text("openai", body).alias("r")).select("conv_id", "turn", "r.text", "r.error")


@query("""
SELECT conv_id, CASE conv_id % 5 WHEN 1 THEN 'number of units' WHEN 2 THEN 'unknown id' WHEN 3 THEN CASE WHEN count(*) > 1 THEN 'repeated id' END WHEN 4 THEN 'not an array' END AS problem FROM conversations GROUP BY conv_id""")
def merged_response_check(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    unit = F.struct(F.col("turn").cast("string").alias("id"), F.col("text"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(unit)).alias("m"))
    c = F.col("conv_id") % 5
    swap = F.transform("m", lambda u, i: F.when((c == 2) & (i == 0), F.struct(F.lit("?").alias("id"), u["text"].alias("text"))).when(c == 3, F.struct(F.element_at("m", 1)["id"].alias("id"), u["text"].alias("text"))).otherwise(u))
    said = F.when(c == 4, F.lit("sorry")).when(c == 1, F.to_json(F.concat("m", F.col("m")))).otherwise(F.to_json(swap))
    return g.select("conv_id", services.merged_check(F.col("m"), said).alias("problem"))


@query("""
SELECT conv_id AS resp, CASE WHEN conv_id % 3 = 0 THEN string_agg(text, '' ORDER BY turn) END AS text, CASE conv_id % 3 WHEN 1 THEN 'incomplete' WHEN 2 THEN 'finish_reason=length' END AS error FROM conversations GROUP BY conv_id""")
def sse_fold(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    lines = t.select(F.col("conv_id").alias("resp"), F.col("turn").alias("seq"), F.concat(F.lit(" data: "), delta).alias("line"))
    other = t.select(F.col("conv_id").alias("resp"), F.col("turn").alias("seq"), F.lit(": comment").alias("line"))
    ids = t.select(F.col("conv_id").alias("resp")).distinct()
    end = ids.filter("resp % 3 <> 1").select("resp", F.lit(10**6).cast("long").alias("seq"), F.when(F.col("resp") % 3 == 0, "data: [DONE]").otherwise('data: {"choices":[{"delta":{},"finish_reason":"length"}]}').alias("line"))
    return services.fold_stream(lines.unionByName(other).unionByName(end))


@query("""
SELECT conv_id, '[' || string_agg('{"id":"' || turn || '","text":' || to_json(text)::VARCHAR || '}', ',' ORDER BY turn) || ']' AS request FROM conversations GROUP BY conv_id""")
def unit_requests(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    members = F.sort_array(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("id"), "text")))
    return t.groupBy("conv_id").agg(members.alias("m")).select("conv_id", services.unit_array(F.col("m")).alias("request"))


@query("""
SELECT conv_id, turn, CASE turn % 3 WHEN 1 THEN NULL ELSE text || '/' || role END AS text, CASE turn % 3 WHEN 1 THEN 'stop_reason=max_tokens' END AS error FROM conversations""")
def response_claude(spark, sf_dir):
    stop = F.when(F.col("turn") % 3 == 1, "max_tokens").otherwise("end_turn")
    body = F.to_json(F.struct(F.array(F.struct(F.col("text")), F.struct(F.concat(F.lit("/"), "role").alias("text"))).alias("content"), stop.alias("stop_reason")))
    r = services.response_text("claude", body)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.text", "r.error")


SERVICE = [(1, '{"data":" x "}'), (2, '{"data":{"text":"y"}}'), (3, '{"data":{"translations":[{"text":"z"}]}}'), (4, '{"text":"w"}'), (5, '{"data":" "}'), (6, '{"a":1}')]
SERVICE_WANT = [(1, "x", None), (2, "y", None), (3, "z", None), (4, "w", None), (5, None, "empty translation"), (6, None, "unknown format")]


@query(f"SELECT k, said AS text, error FROM {sql_values(SERVICE_WANT, 'k, said, error')}")
def response_service(spark, sf_dir):
    return values(spark, SERVICE, "k, body").select("k", services.response_text("deeplx", F.col("body")).alias("r")).select("k", "r.text", "r.error")


STATUSES = [(1, 200, "fine", "3"), (2, 429, "slow down", "3"), (3, 500, "oops", None), (4, 403, "no", None), (5, 400, "maximum context length", "x")]
STATUS_WANT = [(1, None, None, None), (2, "HTTP 429: slow down", 3.0, "RateLimit"), (3, "HTTP 500: oops", None, "Transient"), (4, "HTTP 403: no", None, "Permanent"), (5, "HTTP 400: maximum context length", None, "ContextOverflow")]


@query(f"SELECT k, message, wait::DOUBLE AS wait, kind FROM {sql_values(STATUS_WANT, 'k, message, wait, kind')}")
def status_errors(spark, sf_dir):
    e = services.status_error(F.col("status"), F.col("body"), F.col("header"), F.lit(0.0))
    return values(spark, STATUSES, "k, status, body, header").select("k", e.alias("e")).select("k", "e.message", F.col("e.retry_after_s").alias("wait"), "e.kind")


def _marked(text_: str) -> str:
    return "U:" + text_


@query(f"WITH {UNITS} SELECT book, id, 'U:' || original AS text, 'marker' AS engine_name FROM units WHERE NOT ignored")
def translate_map(spark, sf_dir):
    rows = paragraphs(spark, sf_dir).filter("not ignored")
    groups = packing.group_rows(packing.merge_groups(rows, LIMIT, pages_once=True))
    done = translate_groups(groups, [FunctionEngine(_marked, "marker")], "To <tlang>.", "English", "Upper", policy=Policy(interval=0.0, retry_delay=0.0))
    return done.filter("error is null").select("book", "id", "text", "engine_name")


from . import archives  # noqa: E402, F401  registers its queries, by what is defined above
