"""Queries of whole books: each document is one, packed and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import services, text
from ..operators import checkpoint, markup, packing
from ..operators.translate import FunctionEngine, Policy, ServiceError, batch_results, translate_groups
from ..sources import books
from .registry import LIMIT, ROWS, _rows, query
from .units import UNITS, paragraphs, sql_ignored, sql_normal, sql_strip, table

#: Control characters, which XML can't hold.
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
DOCTYPE = '<!DOCTYPE html [<!ENTITY x "a>b">]>'
EMPHASIS = (' <em class="k" id="e">end</em>', " {{etm_o_00000}}end{{etm_c_00000}}")
OPF = "OEBPS/book%20one.opf"
MEMBERS = ["mimetype", "META-INF/container.xml", "OEBPS/book one.opf", "OEBPS/toc.ncx", "OEBPS/text/one.xhtml", "OEBPS/text/two.xhtml"]
CONTAINER = f'<?xml version="1.0"?><container><rootfiles><rootfile full-path="{OPF}"/></rootfiles></container>'
PACKAGE = (
    '<package><metadata><title>{title}</title><creator>A &lt; B</creator><creator> </creator><creator>C</creator></metadata><manifest>'
    '<item id="n" href="toc.ncx" media-type="application/x-dtbncx+xml"/><item id="b" href="text/two.xhtml" media-type="application/xhtml+xml"/>'
    '<item id="a" href="text/one.xhtml" media-type="application/xhtml+xml"/></manifest><spine toc="n"><itemref idref="a"/><itemref idref="b"/></spine></package>'
)
NCX = "<ncx><navMap><navPoint><navLabel><text> </text></navLabel></navPoint><navPoint><navLabel><text>{title}</text></navLabel></navPoint><navPoint><navLabel><text>Two &amp; more</text></navLabel></navPoint></navMap></ncx>"
TWO = "<html><head></head><body><div><p>Notes.</p></div><script>no()</script></body></html>"


def _clean(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, CONTROL, " "), "\r", " ")


def _escaped(c: Column) -> Column:
    return text.escape_attribute(c)


def _filled(template: str, **parts: Column) -> Column:
    """The template as a column, with its names filled in."""
    pieces: list = [template]
    for name, value in parts.items():
        pieces = [y for x in pieces for y in ([x] if not isinstance(x, str) else [z for i, z in enumerate(x.split("{" + name + "}")) for z in ([value, z] if i else [z])])]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in pieces))


def _page(lines: Column) -> Column:
    """A paragraph a line, every second one with an emphasis at its end."""
    inside = F.transform(lines, lambda x, i: F.concat(F.lit("<p>"), _escaped(x), F.when(i % 2 == 1, F.lit(EMPHASIS[0])).otherwise(F.lit("")), F.lit("</p>")))
    return F.concat(F.lit(DOCTYPE + "<html><head></head><body>"), F.array_join(inside, ""), F.lit("</body></html>"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("book"), F.split(_clean(F.coalesce("text", F.lit(""))), "\n").alias("lines"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("book", F.lit("text/one.xhtml").alias("page"), _page(F.col("lines")).alias("html"))


#: WITH-clause entry `body`: the paragraphs of the pages, as units.
BODY = rf"""
docs AS (SELECT doc_id::VARCHAR AS book, string_split(replace(regexp_replace(coalesce(text, ''), '{CONTROL}', ' ', 'g'), chr(13), ' '), chr(10)) AS lines FROM documents),
raw AS (SELECT book, unnest(lines) AS line, unnest(range(0, len(lines))) AS k FROM docs),
visible AS (SELECT book, k, {sql_normal("CASE WHEN k % 2 = 1 THEN line || ' end' ELSE line END")} AS seen, {sql_normal(f"CASE WHEN k % 2 = 1 THEN line || '{EMPHASIS[1]}' ELSE line END")} AS original, line FROM raw),
body AS (SELECT book, k, original, {sql_ignored("seen")} AS ignored, md5('v2:body:text/one.xhtml:' || k) AS id, line FROM visible WHERE seen <> '')"""


@query(f"WITH {BODY} SELECT book, k::VARCHAR AS key, original, ignored, id FROM body")
def page_units(spark, sf_dir):
    return markup.keyed_elements(markup.extract_pages(_pages(spark, sf_dir))).select("book", "key", "original", "ignored", "id")


def _sql_page(position: str) -> str:
    """The written page in SQL: every paragraph that isn't ignored with its translation, T and its own text."""
    esc = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    own = f"'<p>' || {esc.format('line')} || CASE WHEN k % 2 = 1 THEN '{EMPHASIS[0]}' ELSE '' END || '</p>'"
    words = esc.format("replace(original, '" + EMPHASIS[1].strip() + "', chr(1))")
    end = '<em id="e" class="k">end</em>' if position == "only" else '<em class="k">end</em>'
    said = f"replace({words}, chr(1), '{end}')"
    new = f"""'<p class="et-translation"' || '{'' if position == 'only' else ' style="display:block"'}' || ' lang="de" dir="ltr">T ' || {said} || '</p>'"""
    return f"string_agg(CASE WHEN original IS NULL OR ignored THEN {own} ELSE {new if position == 'only' else own + ' || ' + new} END, '' ORDER BY k)"


def _sql_written(position: str) -> str:
    whole = f"""CASE WHEN count(*) FILTER (NOT ignored) = 0 THEN '{DOCTYPE}<html><head></head><body>' ELSE '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '{DOCTYPE}' || chr(10) || '<html><head></head><body>' END"""
    plain = "replace(replace(replace(replace(line, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"
    as_is = f"string_agg('<p>' || {plain} || CASE WHEN k % 2 = 1 THEN '{EMPHASIS[0]}' ELSE '' END || '</p>', '' ORDER BY k)"
    return f"{whole} || CASE WHEN count(*) FILTER (NOT ignored) = 0 THEN {as_is} ELSE {_sql_page(position)} END || '</body></html>'"


def _inject(spark, sf_dir, position):
    pages = _pages(spark, sf_dir)
    said = markup.keyed_elements(markup.extract_pages(pages)).filter("not ignored").select("book", "page", "id", F.concat(F.lit("T "), "original").alias("translation"))
    return markup.inject_pages(pages, said, look=markup.Look(position=position, lang="de", direction="ltr")).select("book", "html", F.col("injected").cast("long").alias("injected"))


def _sql_inject(position):
    return f"WITH {BODY}, every AS (SELECT raw.book, raw.k, raw.line, body.original, coalesce(body.ignored, TRUE) AS ignored FROM raw LEFT JOIN body USING (book, k)) SELECT book, {_sql_written(position)} AS html, count(*) FILTER (NOT ignored) AS injected FROM every GROUP BY book"


@query(_sql_inject("below"))
def page_below(spark, sf_dir):
    return _inject(spark, sf_dir, "below")


@query(_sql_inject("only"))
def page_only(spark, sf_dir):
    return _inject(spark, sf_dir, "only")


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, content): each document as an EPUB, its first page in UTF-16 for odd ids."""
    d = _documents(spark, sf_dir)
    title = _escaped(F.col("lines")[0])
    one = _page(F.col("lines"))
    parts = [
        F.lit("application/epub+zip"), F.lit(CONTAINER), _filled(PACKAGE, title=title), _filled(NCX, title=title), one, F.lit("﻿" + TWO),
    ]
    wide = F.col("book").cast("long") % 2 == 1
    content = [F.when(wide, F.encode(p, "UTF-16")).otherwise(F.encode(p, "UTF-8")) if p is one else F.encode(p, "UTF-8") for p in parts]
    members = F.array(*(F.struct(F.lit(i).alias("idx"), F.lit(name).alias("name"), c.alias("content")) for i, (name, c) in enumerate(zip(MEMBERS, content, strict=True))))
    packed = books.pack_members(d.select("book", F.explode(members).alias("m")).select("book", "m.*"))
    context = spark.sparkContext
    if context.getCheckpointDir() is None and (shared := spark.conf.get("spark.checkpoint.dir", None)):
        context.setCheckpointDir(shared)
    # stored where there is a folder for it, since each reader would pack the books again
    return packed.checkpoint() if context.getCheckpointDir() else packed


#: WITH-clause entry `elements`: all elements of the books in reading order.
ELEMENTS = f"""{BODY},
titles AS (SELECT book, {sql_normal("lines[1]")} AS t FROM docs),
meta AS (
  SELECT book, 0 AS part, 0 AS nth, 'metadata' AS kind, 'OEBPS/book one.opf' AS page, 'title:0' AS key, t AS original, FALSE AS ignored FROM titles WHERE t <> ''
  UNION ALL SELECT book, 0, n, 'metadata', 'OEBPS/book one.opf', 'creator:' || c, v, TRUE FROM titles, (VALUES (1, 0, 'A < B'), (2, 2, 'C')) AS x(n, c, v)
), labels AS (SELECT book, t AS original, 0 AS nth FROM titles WHERE t <> '' UNION ALL SELECT book, 'Two & more', 1 FROM titles),
toc AS (SELECT book, 1 AS part, nth, 'toc' AS kind, 'toc.ncx' AS page, (row_number() OVER (PARTITION BY book ORDER BY nth) - 1)::VARCHAR AS key, original, FALSE AS ignored FROM labels),
pages2 AS (SELECT book, 2 AS part, k AS nth, 'body' AS kind, 'text/one.xhtml' AS page, k::VARCHAR AS key, original, ignored FROM body UNION ALL SELECT book, 3, 0, 'body', 'text/two.xhtml', '0', 'Notes.', FALSE FROM docs),
elements AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY part, nth) - 1 AS ord, md5('v2:' || kind || ':' || page || ':' || key) AS id FROM (FROM meta UNION ALL FROM toc UNION ALL FROM pages2))"""


@query(f"WITH {ELEMENTS} SELECT book, ord, kind, page, key, original, ignored, id FROM elements")
def book_scan(spark, sf_dir):
    return books.scan_files(_archives(spark, sf_dir), translate_title=True).select("book", "ord", "kind", "page", "key", "original", "ignored", "id")


def _sql_splice(template: str, title: str) -> str:
    a, b = template.replace("'", "''").split("{title}")
    return f"'{a}' || {title} || '{b}'"


SQL_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
SQL_ATTR = "replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""
WITH {BODY}, every AS (SELECT raw.book, raw.k, raw.line, body.original, coalesce(body.ignored, TRUE) AS ignored FROM raw LEFT JOIN body USING (book, k)),
one AS (SELECT book, {_sql_written("below")} AS html, count(*) FILTER (NOT ignored) AS n FROM every GROUP BY book),
t AS (SELECT docs.book, {sql_normal("lines[1]")} AS t, lines[1] AS raw, html, n FROM docs JOIN one USING (book))
SELECT book, name, content, n + (t <> '')::INT AS injected FROM t, LATERAL (
  SELECT 'mimetype' AS name, 'application/epub+zip' AS content
  UNION ALL SELECT 'META-INF/container.xml', '{CONTAINER}'
  UNION ALL SELECT 'OEBPS/book one.opf', {_sql_splice(PACKAGE, "'Mine &amp; more'")}
  UNION ALL SELECT 'OEBPS/toc.ncx', {_sql_splice(NCX, "CASE WHEN t = '' THEN " + SQL_ATTR.format("raw") + " ELSE " + SQL_ESC.format("t || ' T ' || t") + " END")}
  UNION ALL SELECT 'OEBPS/text/one.xhtml', html
  UNION ALL SELECT 'OEBPS/text/two.xhtml', '{TWO}')""")
def book_rewrite(spark, sf_dir):
    """Books with the first page's and the first label's translation, a title of one's own, and all other files as they were."""
    files = _archives(spark, sf_dir)
    found = books.scan_files(files, translate_title=True)
    first = (F.col("page") == "text/one.xhtml") | (F.col("kind") == "toc") & (F.col("original") != "Two & more")
    said = found.filter(first & ~F.col("ignored")).select("book", "id", F.concat(F.lit("T "), "original").alias("translation"))
    made = books.rewrite_books(files, said, look=markup.Look(position="below", lang="de", direction="ltr"), title="Mine & more")
    members = books.members_of(made, keep=("injected",))
    read = F.when(F.startswith("content", F.lit(b"\xfe\xff")), F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""))
    return members.select("book", "name", read.alias("content"), "injected")


# ---- checkpoints and engines ------------------------------------------------


@query(f"WITH {ROWS} SELECT ord, id, original, translation FROM ck WHERE NOT ignored")
def cache_active(spark, sf_dir):
    return checkpoint.active(_rows(spark, sf_dir)).select("ord", "id", "original", "translation")


@query(f"WITH {ROWS} SELECT 'some' AS what, count(*) FILTER (ord % 2 = 0) AS n FROM ck UNION ALL SELECT 'all', count(*) FILTER (NOT ignored) FROM ck")
def cache_cleared(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    some = checkpoint.cleared(rows, rows.filter("ord % 2 = 0").select("id"))
    return some.select(F.lit("some").alias("what"), "n").unionByName(checkpoint.cleared(rows).select(F.lit("all").alias("what"), "n"))


def _without_the(text_: str) -> str:
    if "the" in text_:
        raise ServiceError("HTTP 500: the", 500)
    return "U:" + text_


def _anything(text_: str) -> str:
    return "F:" + text_


def _translated(spark, sf_dir, engines):
    rows = paragraphs(spark, sf_dir).filter("not ignored")
    groups = packing.group_rows(packing.merge_groups(rows, LIMIT, pages_once=True))
    policy = Policy(max_retries=1, retry_delay=0.0, interval=0.0, max_failures=10**9)
    return translate_groups(groups, engines, "To <tlang>.", "English", "Upper", policy=policy)


@query(f"WITH {UNITS} SELECT book, id, CASE WHEN contains(original, 'the') THEN 'F:' ELSE 'U:' END || original AS text, CASE WHEN contains(original, 'the') THEN 'second' ELSE 'first' END AS engine_name FROM units WHERE NOT ignored")
def translate_fallback(spark, sf_dir):
    done = _translated(spark, sf_dir, [FunctionEngine(_without_the, "first"), FunctionEngine(_anything, "second")])
    return done.filter("error is null").select("book", "id", "text", "engine_name")


@query(f"WITH {UNITS} SELECT count(*) FILTER (NOT contains(original, 'the')) AS done, count(*) FILTER (contains(original, 'the')) AS failed, 0::BIGINT AS stopped FROM units WHERE NOT ignored")
def outcome_counts(spark, sf_dir):
    return batch_results(_translated(spark, sf_dir, [FunctionEngine(_without_the, "first")]))


BEYOND = r"[^\x00-\x7F]"


@query(rf"""
WITH t AS (SELECT doc_id, {sql_strip("coalesce(text, '')")} AS t FROM documents),
p AS (SELECT *, string_split(t, '.') AS parts FROM t),
j AS (SELECT *, list_max(list_filter(range(1, len(parts) + 1), lambda i: regexp_matches({sql_strip("parts[i]")}, '{BEYOND}'))) AS j FROM p)
SELECT doc_id, CASE WHEN NOT regexp_matches(t, '{BEYOND}') THEN t WHEN j > 1 THEN {sql_strip("array_to_string(parts[j:], '.')")}
  ELSE {sql_strip(r"regexp_extract_all(t, '[ .,;:\-\x{80}-\x{10FFFF}]*[\x{80}-\x{10FFFF}]')[-1]")} END AS text, NULL::VARCHAR AS error FROM j""")
def response_reasoning(spark, sf_dir):
    """Responses whose text is what a reasoning ends in."""
    message = F.struct(F.lit("").alias("content"), F.col("text").alias("reasoning_content")).alias("message")
    body = F.to_json(F.struct(F.array(F.struct(message)).alias("choices")))
    return table(spark, sf_dir, "documents").select("doc_id", services.response_text("openai", body).alias("r")).select("doc_id", "r.text", "r.error")


SYSTEM = 'Say "it" in <tlang>.\nOnly that.'


@query(f"""
SELECT conv_id, turn, '{{"model":"m","messages":[{{"role":"system","content":' || to_json('{SYSTEM}')::VARCHAR || '}},{{"role":"user","content":' || to_json(coalesce(text, ''))::VARCHAR || '}}],"top_p":0.8,"stream":true,"seed":1}}' AS openai,
  '{{"model":"c","max_tokens":9,"system":' || to_json('{SYSTEM}')::VARCHAR || ',"messages":[{{"role":"user","content":' || to_json(coalesce(text, ''))::VARCHAR || '}}],"temperature":0.3}}' AS claude FROM conversations""")
def request_lines(spark, sf_dir):
    said = F.coalesce("text", F.lit(""))
    openai = services.request_json("openai", "m", said, SYSTEM, sampling="top_p", top_p=0.8, extra={"seed": 1}, stream=True)
    claude = services.request_json("claude", "c", said, SYSTEM, extra={"max_tokens": 9})
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", openai.alias("openai"), claude.alias("claude"))
