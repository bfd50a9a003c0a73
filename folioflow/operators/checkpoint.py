"""The checkpoint table: what has been done for one combination of book and settings.

A checkpoint is a folder of Parquet with a part for each cache_key. Statements
are DataFrame in, DataFrame out; `Checkpoint` writes a new version of a key's
part beside the old ones; readers take the last one that Spark has marked as
complete, so a job that is lost or tried twice changes nothing they see.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "cache_key string, ord long, id string, md5 string, raw string, original string, ignored boolean, attributes string, page string, translation string, engine_name string, target_lang string"
EXTRACTED = ["md5", "raw", "original", "ignored", "attributes", "page"]
DONE = ["translation", "engine_name", "target_lang"]


def as_rows(elements: DataFrame) -> DataFrame:
    """elements(cache_key, ord, id, kind, page, signature, raw, original, ignored) as rows that aren't done yet."""
    none = F.lit(None).cast("string")
    return elements.select("cache_key", "ord", "id", F.col("signature").alias("md5"), "raw", "original", "ignored", F.col("kind").alias("attributes"), "page", none.alias("translation"), none.alias("engine_name"), none.alias("target_lang"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows are added after the old ones; known ids keep what is done and their place, and take the rest; others stay.

    Rows are matched by (cache_key, id). New ones get places after the key's
    last, in the order of their own `ord`.
    """
    n = new.select("cache_key", "id", F.col("ord").alias("__ord"), *(F.col(c).alias(f"__{c}") for c in EXTRACTED), F.lit(True).alias("__new"))
    both = old.withColumn("__old", F.lit(True)).join(n, ["cache_key", "id"], "full_outer")
    # places of new rows: after the last old one, by rank among the new ones of the key
    last = old.groupBy("cache_key").agg(F.max("ord").alias("__last"))
    fresh = new.join(old.select("cache_key", "id"), ["cache_key", "id"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("cache_key").orderBy("ord", "id"))
    placed = fresh.select("cache_key", "id", rank.alias("__rank")).join(last, "cache_key", "left").select("cache_key", "id", (F.coalesce("__last", F.lit(-1)) + F.col("__rank")).alias("__place"))
    out = both.join(placed, ["cache_key", "id"], "left")
    known = F.col("__new").isNotNull()
    return out.select("cache_key", F.coalesce("ord", "__place").alias("ord"), "id", *(F.when(known, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in EXTRACTED), *DONE)


def pending(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("ignored") & F.col("translation").isNull())


def active(rows: DataFrame) -> DataFrame:
    return rows.filter(~F.col("ignored"))


def first_pending(rows: DataFrame, n: int) -> DataFrame:
    """The first n pending rows in order; all for n of 0."""
    return pending(rows).orderBy("ord").limit(n) if n > 0 else pending(rows)


def counts(rows: DataFrame) -> DataFrame:
    """(translated, total) over the rows that aren't ignored."""
    kept = ~F.col("ignored")
    return rows.agg(F.count_if(kept & F.col("translation").isNotNull()).alias("translated"), F.count_if(kept).alias("total"))


def update_translations(rows: DataFrame, done: DataFrame) -> DataFrame:
    """rows with what done(id, translation, engine_name, target_lang) says of them."""
    d = done.select("id", F.lit(True).alias("__hit"), *(F.col(c).alias(f"__{c}") for c in DONE))
    joined = rows.join(d, "id", "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in DONE else c for c in rows.columns))


def clear(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Undone: the rows of ids(id), or all that aren't ignored."""
    none = F.lit(None).cast("string")
    if ids is None:
        return rows.select(*(F.when(F.col("ignored"), F.col(c)).otherwise(none).alias(c) if c in DONE else c for c in rows.columns))
    hit = rows.join(ids.select("id", F.lit(True).alias("__hit")).distinct(), "id", "left")
    return hit.select(*(F.when(F.col("__hit"), none).otherwise(F.col(c)).alias(c) if c in DONE else c for c in rows.columns))


def cleared(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(n): how many rows clear() matches, done or not."""
    hit = rows.filter(~F.col("ignored")) if ids is None else rows.join(ids.select("id").distinct(), "id", "left_semi")
    return hit.agg(F.count("*").alias("n"))


def apply_review(rows: DataFrame, decisions: DataFrame, engine: str, target_lang: str) -> DataFrame:
    """rows after decisions(id, translation, ignored, retranslate).

    Retranslate: not ignored, undone. Else ignored: ignored, undone. Else with a
    translation: that, under the engine and language given. Else: not ignored.
    """
    d = decisions.select("id", F.lit(True).alias("__hit"), F.col("translation").alias("__t"), F.col("ignored").alias("__i"), F.col("retranslate").alias("__r"))
    hit, again, off, given = F.coalesce("__hit", F.lit(False)), F.col("__r"), F.col("__i"), F.col("__t").isNotNull()
    none = F.lit(None).cast("string")
    new = {"translation": F.col("__t"), "engine_name": F.lit(engine), "target_lang": F.lit(target_lang)}
    value = {c: F.when(~hit, F.col(c)).when(again | off, none).when(given, new[c]).otherwise(F.col(c)).alias(c) for c in DONE}
    value["ignored"] = F.when(~hit, F.col("ignored")).otherwise(~again & off).alias("ignored")
    return rows.join(d, "id", "left").select(*(value.get(c, F.col(c)) for c in rows.columns))


def set_info(old: DataFrame, new: DataFrame) -> DataFrame:
    """info(cache_key, key, value) with the new values over the old ones."""
    kept = old.join(new.select("cache_key", "key"), ["cache_key", "key"], "left_anti")
    return kept.unionByName(new)


def upgrade(rows: DataFrame) -> DataFrame:
    """Rows of an older layout as those of today: missing columns null, `ord` by id where there was none."""
    today = T.StructType.fromDDL(SCHEMA)
    if "ord" not in rows.columns:
        rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("cache_key").orderBy("id")).cast("long") - 1)
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in today))


class Checkpoint:
    """Versions of checkpoint parts under one folder, which may be in any store that Spark writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self, key: str) -> tuple[int, int]:
        """The highest version that is complete, and the highest there is; 0 for none."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.path}/{key}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return 0, 0
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        found = sorted(int(n[2:]) for n in names if n.startswith("v-"))
        whole = [v for v in found if fs.exists(path(f"{self.path}/{key}/v-{v:08d}/_SUCCESS"))]
        return max(whole, default=0), max(found, default=0)

    def read(self, key: str) -> DataFrame:
        version, _ = self._versions(key)
        if not version:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{key}/v-{version:08d}")

    def _waves(self, key: str) -> tuple[list[str], list[str]]:
        """Folders of outcomes that wait, the complete ones; and all that a run has left."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.path}/{key}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return [], []
        left = {s.getPath().toString(): s.getPath().getName() for s in fs.listStatus(folder)}
        found = sorted(p for p, name in left.items() if name.startswith(("wave-", "batches-")))
        return [p for p in found if left[p].startswith("wave-") and fs.exists(path(f"{p}/_SUCCESS"))], found

    def add_wave(self, key: str, outcomes: DataFrame) -> DataFrame:
        """Stores outcomes(id, error, translation, engine_name, target_lang), to be folded in later, and gives them as stored."""
        kept = f"{self.path}/{key}/wave-{os.urandom(8).hex()}"
        outcomes.select("id", "error", *DONE).write.parquet(kept)
        return self.spark.read.parquet(kept)

    def fold(self, key: str) -> None:
        """Brings the rows up to the outcomes that wait, of a lost run too; these go once the rows are written."""
        waves, found = self._waves(key)
        if waves:
            done = self.spark.read.parquet(*waves).filter("error is null").select("id", *DONE)
            self.write(key, update_translations(self.read(key), done))
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for w in found:
            path(w).getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path(w), True)

    def write(self, key: str, rows: DataFrame) -> None:
        _, last = self._versions(key)
        rows.select(*T.StructType.fromDDL(SCHEMA).names).write.parquet(f"{self.path}/{key}/v-{last + 1:08d}")
