"""The tables that stand for books: documents are pages of a book (their source), their lines are units of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys, text


#: A unit's order is its document's id times this and its place there, which is a 32-bit number.
ORDER = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, page, pos, ord, kind, raw, original, ignored, id, signature) of every line with text."""
    # a line is normalised before it is a row, so that no filter on the outcome repeats the work; `outer` spares an inferred one
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("raw"), text.normalize_text(x).alias("original")))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("book"), F.concat(F.lit("text/doc"), "doc_id", F.lit(".xhtml")).alias("page"), F.posexplode_outer(lines).alias("pos", "line"))
    units = docs.select("doc_id", "book", "page", "pos", "line.raw", "line.original", F.lit("body").alias("kind")).filter("original <> ''")
    flagged = units.withColumn("ignored", text.is_noise(F.col("original")) | text.is_non_translatable(F.col("original"), stripped=True))
    key = F.col("pos").cast("string")
    return flagged.select(
        "book", "page", "pos", (F.col("doc_id") * ORDER + F.col("pos")).alias("ord"), "kind", "raw", "original", "ignored",
        keys.uid(F.col("kind"), F.col("page"), key).alias("id"), keys.signature(F.col("kind"), F.col("page"), key, F.col("raw"), F.col("original")).alias("signature"),
    )


SPACES = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def sql_normal(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '[\\x{{200B}}\\x{{FEFF}}]', '', 'g'), '{SPACES}+', ' ', 'g'), '^ | $', '', 'g')"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


SQL_NOISE = r"""regexp_matches({0}, '^[-\d\s.''\\"‘’“”,=~!@#$%^&º*|≈<>?/`—…+:–_(){{}}\[\]]+$')"""
SQL_FIXED = (
    r"({0} = '' OR regexp_matches({0}, '(?i)^(?:https?://|www\.)\S+$') OR regexp_matches({0}, '(?i)^ISBN(?:-1[03])?\s*:?\s*[0-9X][0-9X\-\s]{{8,}}$')"
    r" OR regexp_matches({0}, '(?i)^(?:Figure|Fig\.?|Table)\s*[:#.]?\s*[A-Z0-9]+(?:[.\-][A-Z0-9]+)*[.:]?$')"
    r" OR (regexp_matches({0}, '[0-9]') AND regexp_matches({0}, '^[\d,.\-+eE\s%]+$')))"
)


def sql_ignored(c: str) -> str:
    return f"({SQL_NOISE.format(c)} OR {SQL_FIXED.format(c)})"


#: WITH-clause entry `units`: paragraphs() in SQL.
UNITS = f"""
lines AS (SELECT doc_id, source AS book, 'text/doc' || doc_id || '.xhtml' AS page, unnest(range(0, len(string_split(text, chr(10)))))::INT AS pos, unnest(string_split(text, chr(10))) AS raw FROM documents),
units AS (
  SELECT book, page, pos, doc_id * {ORDER} + pos AS ord, 'body' AS kind, raw, original, {sql_ignored("original")} AS ignored,
    md5('v2:body:' || page || ':' || pos) AS id,
    md5('v2' || chr(0) || 'body' || chr(0) || page || chr(0) || pos || chr(0) || raw || chr(0) || original) AS signature
  FROM (SELECT *, {sql_normal("raw")} AS original FROM lines) WHERE original <> ''
)"""
