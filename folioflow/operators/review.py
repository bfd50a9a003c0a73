"""Human review: what is exported, what may come back, and what that decides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, tokens

PARAGRAPHS = "array<struct<id:string,kind:string,page:string,original:string,translation:string,ignored:boolean,action:string,signature:string>>"
SCHEMA = f"schema_version int, source_content_hash string, element_signature string, title string, paragraphs {PARAGRAPHS}"
VERSION = 1


def export_rows(elements: DataFrame, rows: DataFrame) -> DataFrame:
    """A record for each element: what the checkpoint has for it, else the element's own."""
    have = rows.select("id", F.col("translation"), F.col("ignored").alias("__ignored"))
    return elements.select("ord", "id", "kind", "page", "original", "signature", "ignored").join(have, "id", "left").select("ord", "id", "kind", "page", "original", "translation", F.coalesce("__ignored", "ignored").alias("ignored"), F.lit("keep").alias("action"), "signature")


def write_review(records: DataFrame, path: str, source_hash: str, element_signature: str, title: str, force: bool = False) -> None:
    """One JSON document a file; refuses to replace one unless forced. A review is one file, so its records meet in one task."""
    fields = ["id", "kind", "page", "original", "translation", "ignored", "action", "signature"]
    listed = records.agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("paragraphs"))
    document = listed.select(F.lit(VERSION).alias("schema_version"), F.lit(source_hash).alias("source_content_hash"), F.lit(element_signature).alias("element_signature"), F.lit(title).alias("title"), "paragraphs")
    document.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite" if force else "error").text(path)


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """The document of a review, by its schema; anything else raises when read."""
    return spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def stale(document: DataFrame, source_hash: str, element_signature: str) -> DataFrame:
    """The document, if it isn't of this source, these elements and this version."""
    return document.filter((F.col("schema_version") != VERSION) | (F.col("source_content_hash") != source_hash) | (F.col("element_signature") != element_signature)).drop("paragraphs")


def records(document: DataFrame) -> DataFrame:
    return document.select(F.explode("paragraphs").alias("p")).select("p.*")


def violations(records_: DataFrame, elements: DataFrame) -> DataFrame:
    """(id, violation) of records that may not be imported; if there is one, none is."""
    known = elements.select("id", F.col("original").alias("__original"), F.col("signature").alias("__signature"), F.lit(True).alias("__known"))
    often = records_.groupBy("id").agg(F.count("*").alias("__n"))
    joined = records_.join(often, "id").join(known, "id", "left")
    kept = (F.col("kind") == "body") & (F.col("action") == "keep") & ~F.col("ignored") & F.col("translation").isNotNull()
    said = F.when(F.col("__n") > 1, "repeated id")
    said = said.when(F.col("__known").isNull(), "unknown id")
    said = said.when((F.col("original") != F.col("__original")) | (F.col("signature") != F.col("__signature")), "stale")
    said = said.when(~F.col("action").isin("keep", "retranslate"), "unknown action")
    said = said.when((F.col("action") == "retranslate") & F.col("ignored"), "retranslate and ignored")
    said = said.when(kept & text.is_blank(F.col("translation")), "empty translation")
    first = joined.withColumn("violation", said)
    # tokens are looked at where all else is in order, as normalising may run Python
    broken = kept & F.col("violation").isNull() & ~tokens.is_valid(F.col("original"), tokens.normalized(F.col("translation")))
    return first.select("id", F.coalesce("violation", F.when(broken, "broken tokens")).alias("violation")).filter("violation is not null")


def decisions(records_: DataFrame) -> DataFrame:
    """(id, translation, ignored, retranslate) for checkpoint.apply_review."""
    return records_.select("id", "translation", "ignored", (F.col("action") == "retranslate").alias("retranslate"))
