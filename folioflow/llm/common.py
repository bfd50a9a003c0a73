"""What the corpus operators share: reading, shared folders, document keys."""

from __future__ import annotations

import gc
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id in internal keys; results give the null back.
NULL_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or one of our own in local mode; raises where a cluster names none."""
    set_already = spark.conf.get("spark.checkpoint.dir", None)
    if set_already:
        return set_already
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioflow-"))
        own = spark.sparkContext.getCheckpointDir()
    return own


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows to the shared folder and goes on from there."""
    spark = df.sparkSession
    where = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """The rows as of cut(), with the disk given back of what they were made from.

    Shuffles and cut rows that nothing holds any more stay on disk until the
    driver collects its garbage, which a driver with room to spare doesn't do
    for minutes: the next shuffles would come on top of them.
    """
    out = cut(df)
    del df
    gc.collect()
    out.sparkSession._jvm.System.gc()
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system the path names; nothing happens if it isn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def split_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows joined with groups (one row a key, as an aggregate gives) on keys that have no nulls, so that hot keys can be split.

    The aggregate's own partitions are by the keys, and a join that reuses them
    can't be split; with a hash of the keys as one more key it is dealt anew.
    """
    mark = "__split"
    out = rows.withColumn(mark, F.xxhash64(*keys)).join(groups.withColumn(mark, F.xxhash64(*keys)), [*keys, mark], how)
    return out.drop(mark)


def keyed(docs: DataFrame) -> DataFrame:
    """(k1, k2, text) of each row, text null as empty.

    k1 is the id and k2 a hash of the text: rows that repeat an id with another
    text stay apart, and rows that repeat both are alike in every result.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("k1"),
        F.xxhash64(text).alias("k2"),
        text.alias("text"),
    )


def doc_id() -> Column:
    """The id back from k1."""
    return F.when(F.col("k1") != NULL_ID, F.col("k1")).alias("doc_id")


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """docs with its own columns of these names under reserved ones, and the columns that give docs back."""
    own = {c: f"__own_{c}" for c in docs.columns if c.lower() in names}
    return docs.withColumnsRenamed(own), [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns]
