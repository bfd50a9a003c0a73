"""Structured Streaming fronts: books that arrive, and response lines that arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import services
from ..operators.checkpoint import Checkpoint, upsert


def arriving_books(spark: SparkSession, folder: str, files_per_batch: int = 16) -> DataFrame:
    """New EPUB files of a folder: (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.epub").option("maxFilesPerTrigger", files_per_batch).load(folder)


def upsert_into(store: Checkpoint, rows: DataFrame, key: str, state: str, on_batch: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Streams checkpoint rows into one part of a store. A batch that is tried again changes nothing, as rows are matched by id; of an id's rows in one batch the last by `ord` counts."""

    def merge(batch: DataFrame, _: int) -> None:
        last = F.row_number().over(Window.partitionBy("id").orderBy(F.col("ord").desc(), F.col("md5").desc()))
        new = batch.withColumn("nth", last).filter("nth = 1").drop("nth").withColumn("cache_key", F.lit(key))
        store.write(key, upsert(store.read(key), new))
        if on_batch:
            on_batch(new)

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start()


def fold_arriving(lines: DataFrame, kind: str = "openai", late: str = "10 minutes", every: str = "1 minute") -> DataFrame:
    """Responses from a stream of lines(resp, seq, line, at), each within a window of its time.

    The deltas of a response are kept until the watermark has passed its window,
    then come out once, folded like services.fold_stream().
    """
    window = F.window("at", every)
    told = lines.withWatermark("at", late).groupBy("resp", window).agg(F.collect_list(F.struct("seq", "line")).alias("lines"))
    return told.select("resp", "window", F.explode("lines").alias("l")).select("resp", "window", "l.seq", "l.line")


def fold_batches(arriving: DataFrame, kind: str, write: Callable[[DataFrame], None], state: str) -> StreamingQuery:
    """Runs fold_arriving() to its end and hands each batch of folded responses on."""
    return fold_arriving(arriving, kind).writeStream.outputMode("append").foreachBatch(lambda batch, _: write(services.fold_stream(batch, kind))).option("checkpointLocation", state).trigger(availableNow=True).start()
